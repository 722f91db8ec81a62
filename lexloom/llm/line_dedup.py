"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` is a log-structured store. A run is a table of (hi, lo, n): the 128-bit hash of a line's key and in how
many documents it was found, bucketed by hash and sorted in each bucket. A new batch of documents is dealt to the same buckets,
summed, and merge-anti-joined with the runs of keys that are settled (found in enough documents), so their lines cost nothing
more; runs are not shuffled or sorted again. What remains becomes a run of level 0. When a level holds ``fanout`` runs
they are merged into one of the next level, the keys they had settled go to the run of settled keys, and the
old runs are deleted. Runs can be kept between calls, so later batches need no older text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, remove, spread_join, tidy, written

SPACES = b" \t\n\r\x0b\f"
#: Up to so many settled keys (16 bytes each) go to the workers as one sorted array; more are joined.
SHIPPED_KEYS = 400_000
BATCHES = 4
FANOUT = 3
#: Rows of a batch that a bucket is made for, and most buckets; beyond that buckets grow.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 32_768
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class Run:
    """A bucketed, sorted table of (hi, lo, n) in the shared folder."""

    def __init__(self, counts: DataFrame, buckets: int, min_docs: int):
        self.spark, self.min_docs = counts.sparkSession, min_docs
        self.name, self.path = f"lexloom_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        counts.write.option("path", self.path).option("compression", "zstd").bucketBy(buckets, "hi", "lo").sortBy("hi", "lo").saveAsTable(self.name)

    def pending(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("n") < self.min_docs)

    def settled(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("n") >= self.min_docs)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


class LineRuns:
    """Runs of line keys in ``buckets`` buckets; settled keys are those of at least ``min_docs`` documents."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT, buckets: int = 8):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.levels: list[list[Run]] = [[]]
        self.old: Run | None = None

    def add(self, lines: DataFrame) -> None:
        """Add a batch: rows (hi, lo) or (hi, lo, n), n being how many of the batch's documents have the key."""
        n = F.sum("n") if "n" in lines.columns else F.count(F.lit(1))
        with self._sorted_scans():
            fresh = lines.repartition(self.buckets, "hi", "lo").groupBy("hi", "lo").agg(n.alias("n"))
            self.levels[0].append(self._run(self._unsettled(fresh)))
            level = 0
            while len(self.levels[level]) >= self.fanout:
                self._compact(level)
                level += 1

    @contextmanager
    def _sorted_scans(self):
        """While planning, a bucket of one file counts as sorted."""
        before = self.spark.conf.get(_ORDERED, None)
        self.spark.conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(_ORDERED) if before is None else self.spark.conf.set(_ORDERED, before)

    def _run(self, counts: DataFrame) -> Run:
        return Run(counts, self.buckets, self.min_docs)

    def _all(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _unsettled(self, counts: DataFrame) -> DataFrame:
        """counts without what the runs have settled, by one merge with each."""
        for run in [*self._all(), *([self.old] if self.old else [])]:
            counts = counts.join(run.settled().select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
        return counts

    def _merged(self, runs: list[Run]) -> DataFrame:
        together = reduce(DataFrame.unionByName, [r.pending() for r in runs]).groupBy("hi", "lo").agg(F.sum("n").alias("n"))
        return self._unsettled(together.repartition(self.buckets, "hi", "lo"))  # a key may have been settled after an older run was written

    def _settled(self, runs: list[Run]) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.settled() for r in runs])

    def _compact(self, level: int) -> None:
        runs = self.levels[level]
        merged = self._run(self._merged(runs))
        gone = [*runs, *([self.old] if self.old else [])]
        self.old = self._run(self._settled(gone).repartition(self.buckets, "hi", "lo"))
        self.levels[level] = []
        if len(self.levels) <= level + 1:
            self.levels.append([])
        self.levels[level + 1].append(merged)
        for run in gone:
            run.drop()

    def frequent(self) -> DataFrame:
        """All keys found in at least ``min_docs`` documents: (hi, lo)."""
        runs = self._all()
        if not runs:
            return self.spark.createDataFrame([], "hi long, lo long")
        with self._sorted_scans():
            rest = self._merged(runs).where(F.col("n") >= self.min_docs)
        return self._settled([*runs, *([self.old] if self.old else [])]).unionByName(rest).select("hi", "lo")

    def drop(self) -> None:
        for run in [*self._all(), *([self.old] if self.old else [])]:
            run.drop()
        self.levels, self.old = [[]], None


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    """The distinct keys of at least ``min_chars`` code points of a text's lines."""
    keys = {line_key(x) for x in (text or "").encode("utf-8", "replace").split(b"\n")}
    return {k for k in keys if len(k) >= min_chars and (min_chars < 2 or len(k.decode("utf-8", "replace")) >= min_chars)}


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, place, hi, lo): the distinct keys of each document (doc_id, text); place is a hash of the text."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out, many = [], []
            for text in part.column(2):
                keys = _keys(text.as_py(), min_chars)
                out.extend(map(_hash, keys))
                many.append(len(keys))
            two = np.frombuffer(b"".join(out), dtype=np.int64).reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(part.num_rows), many))
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(two[:, 0]), pa.array(two[:, 1])], ["doc_id", "place", "hi", "lo"])

    return docs.select("doc_id", F.xxhash64("text").alias("place"), "text").mapInArrow(tidy(rows), "doc_id long, place long, hi long, lo long")


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(batch, hi, lo, n): in how many of the rows (batch, text) a key is found, summed already within each Arrow batch, so
    that the most common line is a row a batch and not a row a document."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: dict[int, dict[bytes, int]] = {}
            for batch, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = found.setdefault(batch, {})
                for k in _keys(text.as_py(), min_chars):
                    own[k] = own.get(k, 0) + 1
            for batch, own in found.items():
                two = np.frombuffer(b"".join(map(_hash, own)), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch, np.int32)), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(np.fromiter(own.values(), np.int64, len(own)))], ["batch", "hi", "lo", "n"])

    return docs.select("batch", "text").mapInArrow(tidy(rows), "batch int, hi long, lo long, n long")


def _rebuilt(parts: Iterator[pa.RecordBatch], min_chars: int, drops) -> Iterator[pa.RecordBatch]:
    for part in parts:
        cols: list[list] = [[], [], [], [], []]
        for i in range(part.num_rows):
            raw = (part.column(1)[i].as_py() or "").encode("utf-8", "replace")
            lines = raw.split(b"\n")
            gone = drops(part, i)
            kept = [x for x in lines if len(k := line_key(x)) < min_chars or _hash(k) not in gone]
            text = b"\n".join(kept)
            for col, v in zip(cols, (part.column(0)[i].as_py(), len(lines), len(lines) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT, shipped_keys: int = SHIPPED_KEYS, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

    A text is split at \\n (null or empty: one empty line). A line's key is the line stripped of
    ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of at least ``min_chars`` code points found in at
    least ``min_docs`` documents lose all their lines everywhere (with min_chars 0 the empty key too). Rows that share a doc_id (or have none)
    are one document when counting; each has its own result. Other columns are ignored; an empty table
    gives an empty result. Keys are told apart by 128-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    twins, twins_at = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("_lx_id")), "twins")
    if twins.isEmpty():
        counts = line_counts(dealt, min_chars)
    else:  # rows of one id are one document when counting
        same = F.col("doc_id").eqNullSafe(F.col("_lx_id"))
        shared = document_lines(docs.join(twins, same, "left_semi"), min_chars).select("doc_id", "hi", "lo").distinct()
        shared = shared.groupBy("hi", "lo", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
        counts = line_counts(dealt.join(twins, same, "left_anti"), min_chars).unionByName(shared.select("batch", "hi", "lo", "n"))
    counts, path = written(counts, "lines", partition_by="batch")
    buckets = min(MOST_BUCKETS, 1 + counts.count() // batches // BUCKET_ROWS) if buckets is None else buckets
    runs = LineRuns(spark, min_docs, fanout, buckets)
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select("hi", "lo", "n"))
    frequent, _ = written(runs.frequent(), "lines-frequent")
    runs.drop()
    remove(spark, path)
    remove(spark, twins_at)
    count = frequent.count()
    if count <= shipped_keys:
        keys = [(r.hi, r.lo) for r in frequent.toLocalIterator()]
        packed = np.array(keys, dtype=np.int64).tobytes()
        sent = spark.sparkContext.broadcast(packed)
        cache: dict[str, frozenset] = {}

        def narrow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if "set" not in cache:
                p = sent.value
                cache["set"] = frozenset(p[i : i + 16] for i in range(0, len(p), 16))
            gone = cache["set"]
            return _rebuilt(parts, min_chars, lambda part, i: gone)

        return docs.mapInArrow(tidy(narrow), RESULT)
    lines, _ = written(document_lines(docs, min_chars), "lines")
    gone = spread_join(lines, frequent, ["hi", "lo"], how="left_semi").groupBy("doc_id", "place").agg(F.collect_set(F.struct("hi", "lo")).alias("gone")).withColumnsRenamed({"doc_id": "d", "place": "p"})
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("p")), "left").select("doc_id", "text", "gone")

    def wide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rebuilt(parts, min_chars, lambda part, i: {np.array([x["hi"], x["lo"]], np.int64).tobytes() for x in part.column(2)[i].as_py() or ()})

    return joined.mapInArrow(tidy(wide), RESULT)
