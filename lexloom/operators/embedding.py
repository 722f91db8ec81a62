"""Embedders, and the bookkeeping of what has been embedded.

``HashingEmbedder`` stands in for a neural model: signed feature hashing of character n-grams. It needs no
weights and gives texts with common parts similar vectors; it does not know meanings. Any object with
``dim``, ``model_id`` and ``embed`` can take its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int
    model_id: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    model_id = "char-hash"

    def __init__(self, dim: int = 128, low: int = 3, high: int = 5):
        self.dim, self.low, self.high = dim, low, high

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                w = f"^{word}$"
                for n in range(self.low, self.high + 1):
                    for i in range(max(1, len(w) - n + 1)):
                        h = zlib.crc32(w[i : i + n].encode())
                        row[h % self.dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 0, out / np.maximum(norm, 1e-12), 0.0)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask keeps, scaled to length 1."""
    m = (tokens * mask[..., None]).sum(axis=-2) / np.maximum(mask.sum(axis=-1, keepdims=True), 1)
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def first_pool(tokens: np.ndarray) -> np.ndarray:
    """The first token's vector, scaled to length 1."""
    v = tokens[..., 0, :]
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def embed(texts: DataFrame, embedder: Embedder | None = None, batch: int = 64) -> DataFrame:
    """(id, vector) of (id, text), in batches; the model is made once a worker."""
    model = embedder or HashingEmbedder()
    ident = texts.schema["id"].dataType.simpleString()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for low in range(0, len(part), batch):
                some = part.iloc[low : low + batch]
                yield pd.DataFrame({"id": some["id"], "vector": list(model.embed([t or "" for t in some["text"]]))})

    return texts.select("id", "text").mapInPandas(rows, f"id {ident}, vector array<double>")


def plan(texts: DataFrame, done: DataFrame) -> DataFrame:
    """What is not embedded yet."""
    return texts.join(done.select("id"), "id", "left_anti")


def merge(done: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id."""
    return done.join(new.select("id"), "id", "left_anti").unionByName(new.select(*done.columns))


def is_stale(generation: int, current: int) -> bool:
    """Whether work begun for a generation is no longer wanted."""
    return generation != current


def separation(vectors: DataFrame) -> DataFrame:
    """One row on clusters (id, label, vector): n_clusters, singletons, largest, intra, inter, separation.

    intra is the mean similarity of pairs within a cluster, from sums of unit vectors (no pair is formed); inter is
    that of the clusters' first members.
    """
    from ..functions.vectors import unit

    u = vectors.select("id", "label", unit(F.col("vector")).alias("u"))
    size = u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    dims = u.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    square = dims.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    per = size.join(square, "label").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.max("n").alias("largest"),
        (F.sum(F.col("q") - F.col("n")) / F.sum(F.col("n") * (F.col("n") - 1))).alias("intra"),
    )
    heads = u.join(size.select(F.col("first").alias("id")), "id", "left_semi").select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    both = per.crossJoin(heads).withColumn("inter", (F.col("q") - F.col("n_clusters")) / (F.col("n_clusters") * (F.col("n_clusters") - 1))).drop("q")
    return both.withColumn("separation", (F.col("intra") - F.col("inter")) / F.greatest("intra", "inter"))
