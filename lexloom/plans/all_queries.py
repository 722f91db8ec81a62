"""Imports every module that registers queries."""

from ..registry import ORACLES, QUERIES
from . import graph_queries, tool_queries, vocabulary_queries

__all__ = ["ORACLES", "QUERIES", "graph_queries", "tool_queries", "vocabulary_queries"]
