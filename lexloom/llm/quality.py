"""Quality classifier: random-indexing word vectors, pooled, under a two-layer numpy network.

Every word (hashed to ``WORDS`` buckets) has a fixed sparse random index vector; its word vector sums
the index vectors of its neighbours over the whole corpus, gathered in Spark as sums of fixed size.
So do the shapes of words (capitals, marks, digits, length, whether it repeats the word before). A
document is pooled as means over its words, its distinct words and its shapes. The network is fitted on
at most ``TRAIN_ROWS`` labelled rows and its probabilities are calibrated by a temperature on a part
of these that it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, utf8, written
from .words import mix, spans, words

WORDS, SHAPES, DIM, NONZERO, WINDOW = 1 << 14, 256, 32, 2, 2
ROWS = WORDS + SHAPES
BLOCKS = 65
#: Labelled rows that the network is fitted on, at most: those of the least hashed doc_id.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.003, 1e-4

_UPPER, _MARK, _DIGIT = (np.zeros(256, np.int32) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?!"]] = 1
_MARK[ord("!")] = 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero parts of each row's index vector."""
    h = mix(np.arange(ROWS * NONZERO, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345)).reshape(ROWS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int8)


_AT, _SIGN = _index_vectors()


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the words and of their shapes, and where each text's words begin."""
    number, first = words(raw, at)
    if not len(number):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    start, end = spans(raw, at)
    size = end - start + 1

    def share(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[raw]))
        return total[end + 1] - total[start]

    upper, mark, digit = share(_UPPER), share(_MARK), share(_DIGIT)
    echo = np.zeros(len(number), bool)
    echo[1:] = number[1:] == number[:-1]
    echo[first[:-1][first[:-1] < len(number)]] = False
    loud = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper < size, 2, 3)))
    shape = ((loud * 4 + np.minimum(mark, 3)) * 2 + (digit > 0)) * 2 + echo
    shape = shape * 4 + np.digitize(size, (3, 8, 16))
    return (number >> np.uint64(50)).astype(np.int64), WORDS + shape.astype(np.int64), first


def _neighbours(rows: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places in the flat ROWS x (DIM + 1) table, and what to add there: the index vectors of each row's
    neighbours in the same text, and one for the row itself in the last column."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    wide = DIM + 1
    at, add = [rows * wide + DIM], [np.ones(len(rows), np.int8)]
    for d in range(1, WINDOW + 1):
        near = np.flatnonzero(text[d:] == text[:-d]) if len(rows) > d else np.zeros(0, np.int64)
        a, b = rows[near + d], rows[near]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                at.append(x * wide + _AT[y, k])
                add.append(_SIGN[y, k])
    return at, add


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ROWS * (DIM + 1), np.int64)
    for part in parts:
        raw, at = utf8(part.column(0))
        for low, high in slices(at):
            word, shape, first = tokens(raw[at[low] : at[high]], at[low : high + 1] - at[low])
            if len(word):
                place, add = (np.concatenate([*x, *y]) for x, y in zip(_neighbours(word, first), _neighbours(shape, first), strict=True))
                total += np.bincount(place, add, len(total)).astype(np.int64)
    if total.any():
        yield _blobs(dict(enumerate(np.split(total, BLOCKS))))


def _blobs(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.astype("<i8").tobytes() for b in blocks.values()], pa.binary())], ["block", "data"])


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the blocks of the same number, one batch at a time."""
    blocks: dict[int, np.ndarray] = {}
    for part in parts:
        for block, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            more = np.frombuffer(data.as_py(), "<i8")
            blocks[block] = blocks[block] + more if block in blocks else more
    if blocks:
        yield _blobs(blocks)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all rows, from all texts. A task leaves BLOCKS blocks; they are added by spread
    tasks first, then by block, so that no task gathers what all tasks have left."""
    parts = docs.select("text").mapInArrow(tidy(_contexts), "block int, data binary")
    spread = parts.withColumn("salt", F.spark_partition_id() % 8).repartition("block", "salt").select("block", "data")
    once = spread.mapInArrow(tidy(_summed), "block int, data binary")
    done = once.repartition("block").mapInArrow(tidy(_summed), "block int, data binary")
    total = np.zeros((BLOCKS, ROWS * (DIM + 1) // BLOCKS), np.int64)
    for row in done.collect():  # BLOCKS rows
        total[row.block] += np.frombuffer(row.data, "<i8")
    table = total.reshape(ROWS, DIM + 1).astype(np.float64)
    count = table[:, DIM]
    vectors = table[:, :DIM]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    # a word's own index vector keeps words apart that have the same company
    own = np.zeros((ROWS, DIM))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(ROWS), _AT[:, k]), _SIGN[:, k])
    weight = np.log1p(max(count[:WORDS].sum(), 1) / np.maximum(count, 1)) / np.log1p(max(count[:WORDS].sum(), 1))
    weight[WORDS:] = 1
    return ((vectors + 0.5 * own) * weight[:, None]).astype(np.float32)


N_FEATURES = 3 * DIM + 3


def features(raw: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    out = np.zeros((n, N_FEATURES))
    word, shape, first = tokens(raw, at)
    count = np.diff(first)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    text = np.repeat(np.arange(n), count)
    distinct = np.unique(text << 14 | word)
    kinds = np.bincount(distinct >> 14, minlength=n)

    def mean(rows: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.add.reduceat(vectors[rows], begin, axis=0) / many[:, None]

    out[some, :DIM] = mean(word, first[some], count[some])
    out[some, DIM : 2 * DIM] = mean(distinct & (WORDS - 1), np.searchsorted(distinct >> 14, some), kinds[some])
    out[some, 2 * DIM : 3 * DIM] = mean(shape, first[some], count[some])
    out[:, -3] = np.log1p(count)
    out[some, -2] = kinds[some] / count[some]
    out[some, -1] = np.bincount(text, (shape >> 2) & 1, n)[some] / count[some]
    return out


class Network:
    """Features -> HIDDEN (tanh) -> logit, divided by a temperature."""

    def __init__(self):
        self.constant: float | None = 0.5
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        if len(y) < 10 or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        self.constant = None
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        held = order[: max(2, len(y) // 5)]
        used = order[len(held) :]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(EPOCHS):
            for batch in np.array_split(r.permutation(used), max(1, len(used) // BATCH)):
                h = np.tanh(z[batch] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[batch]) / len(batch)
                back = np.outer(e, p[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate((z[batch].T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], np.array([e.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        logit, best = self._logit(x[held]), np.inf
        for temperature in np.geomspace(0.5, 8, 40):
            q = np.clip(1 / (1 + np.exp(-logit / temperature)), 1e-9, 1 - 1e-9)
            loss = -(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean()
            if loss < best:
                best, self.temperature = loss, float(temperature)
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        # not by a matrix product, whose last digits depend on a row's place in the batch
        hidden = np.tanh(np.einsum("ij,jk->ik", z, self.p[0]) + self.p[1])
        return np.clip((hidden * self.p[2]).sum(axis=1) + self.p[3], -60, 60)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self._logit(x) / self.temperature))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _featured(parts: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in parts:
        raw, at = utf8(part.column(0))
        for low, high in slices(at):
            yield part.slice(low, high - low), features(raw[at[low] : at[high]], at[low : high + 1] - at[low], vectors)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts; the network from at most ``train_rows`` labelled rows that are not held out.

    Labels other than 0 and 1 are ignored; of a document's labels the larger counts.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen, _ = written(chosen, "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    sent = spark.sparkContext.broadcast(vectors)

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _featured(parts, sent.value):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())], ["y", "x"])

    got = rows.mapInArrow(tidy(learn), "y int, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), "<f4").reshape(-1, N_FEATURES).astype(np.float64)
    y = got["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[:4], y))  # rows come in any order
    return vectors, Network().fit(x[order], y[order])


def classify(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text decides; a null text counts as an empty one and has a score too. Without labels of both
    kinds all rows have one score. A row without a doc_id is not held out; repeated rows repeat; other
    columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for part, x in _featured(parts, vectors):
            score = network.probability(x)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ident = F.col("doc_id").cast("long")
    return docs.select("text", ident.alias("doc_id"), held_out(ident).alias("held_out")).mapInArrow(tidy(rows), "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    return classify(docs, *train(docs, labels, **bounds))
