"""The corpus pipeline: five operators over ``documents``, each stage on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared
folder and reads again before the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.bpe import encode_decode
from lexloom.llm.common import read_table, written
from lexloom.llm.decontaminate import drop_contaminated
from lexloom.llm.exact_dedup import drop_copies
from lexloom.llm.language_id import drop_unidentified
from lexloom.llm.minhash import drop_near_duplicates
from lexloom.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts, those without letters and foreign ones go. Rows are judged in place."""
    return drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the least doc_id; one without an id only where no equal text has one."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % equal shingles of five words the least doc_id; rows without an id stay."""
    return drop_near_duplicates(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``; decided by the text, so rows without an id are too."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), k=5, percent=80, by_text=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and of the decoded text. A null text has no tokens; an empty
    table gives an empty result."""
    # workers live beside what earlier stages left, so they remember fewer words
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True, keep=("lang", "source"), memo_words=200_000)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("leaks", leaks), ("encode", encode)]

#: Language models and byte-pair merges have no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
