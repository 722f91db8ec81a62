"""Benchmark decontamination: short test items contained in long documents.

A MinHash containment search partitioned by item size. An item of n distinct shingles that a
document contains to at least ``percent`` % lacks at most f = floor((100 - percent) % of n) of them
there. Its sketch is its bottom-m MinHash (the m least shingle numbers), with m over f and fixed for each partition of
item sizes. Each partition has a bound, the greatest number in its sketches; a document's signature
for the partition is its numbers up to that bound, so it grows with the document and not with the
share that the item has of it. A document that contains an item has at least m - f of the item's sketch in its
signature, so none is missed, at any length of the document; banded MinHash with a Jaccard far below 0.01
would miss most. Candidates are confirmed on exact shingles.

Both sides, on both ways, are lower-cased by one function, character by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, slices, spread_join, tidy, utf8, written
from .words import exact_shingles, shingle_rows, words

#: Items whose texts together have at most so many bytes are shipped to the workers.
SHIPPED_BYTES = 32 << 20
#: Items whose exact shingles a worker keeps, at most.
KEPT_ITEMS = 1024

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NAMES = ["doc_id", "item_id", "n_shared", "n_item", "containment"]


def lowered(texts: pa.Array) -> pa.Array:
    """Each character's own lower-case one, whatever stands beside it."""
    return pc.utf8_lower(texts)


def _words(low: bytes) -> list[bytes]:
    return _WORD.findall(low)


def item_words(text: str | None) -> list[bytes]:
    """Words of letters and digits: case, punctuation and spacing do not hide a passage."""
    return _words(lowered(pa.array([text or ""]))[0].as_py().encode())


def sketch_size(n: int, percent: int) -> int:
    """Least m so that a document lacking all m of an item's n shingles is below ``percent``; for the
    size partition [2**i, 2**(i + 1)) of n, taken at its largest size but never over n."""
    top = (1 << n.bit_length()) - 1
    return min(n, (100 - percent) * top // 100 + 1)


def least_hits(n: int, percent: int) -> int:
    """How many of its sketch's numbers a document has at least that contains an item of n shingles."""
    return sketch_size(n, percent) - (100 - percent) * n // 100


def _numbers(low: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle numbers, where each row's begin) of lower-cased texts, slice by slice."""
    raw, at = utf8(low)
    for i, j in slices(at):
        yield i, *shingle_rows(*words(raw[at[i] : at[j]], at[i : j + 1] - at[i], plain=True), k)


def _sketches(low: pa.Array, k: int, percent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, size, sketch) of the lower-cased items that have words."""
    for first, made, begin in _numbers(low, k):
        for i in range(len(begin) - 1):
            found = np.unique(made[begin[i] : begin[i + 1]])
            if len(found):
                yield first + i, len(found), found[: sketch_size(len(found), percent)]


class Partition:
    """The sketches of items of like size: sorted numbers, and for each the items that have it."""

    def __init__(self, numbers: np.ndarray, owners: np.ndarray):
        order = np.argsort(numbers, kind="stable")
        self.numbers, first = np.unique(numbers[order], return_index=True)
        self.first, self.owners = np.append(first, len(numbers)).astype(np.int64), owners[order]
        self.bound = self.numbers[-1]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.numbers >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, made: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) for each number that a row's signature shares with an item's sketch."""
        own = np.flatnonzero(made <= self.bound)
        own = own[self.filter[(made[own] >> np.uint64(44)).astype(np.int64)]]
        number = made[own]
        place = np.searchsorted(self.numbers, number)
        equal = self.numbers[place] == number
        own, place = own[equal], place[equal]
        if not len(own):
            return own, own
        row = np.searchsorted(begin, own, side="right") - 1
        once = np.unique(row * len(self.numbers) + place)
        row, place = once // len(self.numbers), once % len(self.numbers)
        size = self.first[place + 1] - self.first[place]
        take = np.repeat(self.first[place] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
        return np.repeat(row, size), self.owners[take].astype(np.int64)


class Items:
    """Distinct item texts, lower-cased, and their sketches by size partition; all in arrays."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int):
        self.k, self.percent = k, percent
        texts: dict[str, int] = {}
        who = np.array([texts.setdefault(t, len(texts)) for _, t in items], np.int64)
        self.low = lowered(pa.array(list(texts), pa.large_string()))
        order = np.argsort(who, kind="stable")
        self.ids = np.array([i for i, _ in items], np.int64)[order]
        self.first = np.searchsorted(who[order], np.arange(len(texts) + 1))
        self.need = np.zeros(len(texts), np.int64)
        sketches: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for row, n, sketch in _sketches(self.low, k, percent):
            self.need[row] = least_hits(n, percent)
            sketches.setdefault(n.bit_length(), []).append((sketch, np.full(len(sketch), row, np.int32)))
        self.partitions = [Partition(*map(np.concatenate, zip(*sketches[c], strict=True))) for c in sorted(sketches)]
        self.exact: dict[int, set[bytes]] = {}

    def __getstate__(self):
        return self.__dict__ | {"exact": {}}

    def candidates(self, made: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(row, items of which it shares enough)."""
        found = [p.hits(made, begin) for p in self.partitions]
        if not found:
            return
        row, item = (np.concatenate(x) for x in zip(*found, strict=True))
        pair, count = np.unique(row * len(self.need) + item, return_counts=True)
        pair = pair[count >= self.need[pair % len(self.need)]]
        row, item = pair // len(self.need), pair % len(self.need)
        for own in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1) if len(row) else ():
            yield int(row[own[0]]), item[own].tolist()

    def shingles(self, item: int) -> set[bytes]:
        if item not in self.exact:
            if len(self.exact) >= KEPT_ITEMS:
                self.exact.clear()
            self.exact[item] = exact_shingles(_words(self.low[item].as_py().encode()), self.k)
        return self.exact[item]

    def contained(self, low: bytes, items: list[int]) -> Iterator[tuple[int, int, int]]:
        """(item id, shared, size) for those of the items that the lower-cased text contains."""
        own = exact_shingles(_words(low), self.k)
        for item in items:
            exact = self.shingles(item)
            shared = len(exact & own)
            if 100 * shared >= self.percent * len(exact):
                for ident in self.ids[self.first[item] : self.first[item + 1]].tolist():
                    yield ident, shared, len(exact)


RESULT = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[j], pa.int64()) for j in range(4)] + [pa.array(cols[4], pa.float64())], _NAMES)


def _pairs(parts: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for part in parts:
        low, out = lowered(part.column(1)), []
        for first, made, begin in _numbers(low, items.k):
            for row, near in items.candidates(made, begin):
                ident = part.column(0)[first + row].as_py()
                out.extend((ident, item, c, n, c / n) for item, c, n in items.contained(low[first + row].as_py().encode(), near))
        yield _batch(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """One row per document and test item it contains: doc_id, item_id, n_shared, n_item, containment.

    Words are runs of ASCII letters, digits and non-ASCII characters of the text, each character lower-cased by itself. An item
    is contained when the document has at least ``percent`` % of the item's distinct shingles of k words;
    an item of fewer words is one shingle, met only by a document of just these words. Items and
    documents without words, and items without an id, give no rows; a document without an id is reported
    with a null. Rows of documents that repeat are each reported; items that share an id are each
    searched. Other columns are ignored; empty tables give an empty result. Items are shipped when
    their texts have at most ``shipped_bytes`` bytes, else searched by a join on the sketches; the results are equal.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    if size <= shipped_bytes:
        sent = spark.sparkContext.broadcast(Items(sorted({(r.item_id, r.text) for r in items.toLocalIterator()}), k, percent))
        return docs.mapInArrow(tidy(lambda parts: _pairs(parts, sent.value)), RESULT)
    return _joined(docs, items, k, percent)


def _joined(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """The same for item tables of any size: signatures and sketches are joined, then both texts stand side by side."""
    spark = docs.sparkSession
    texts, _ = written(items.select("text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")

    def sketched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, n, sketch in _sketches(lowered(part.column(0)), k, percent):
                m = len(sketch)
                cols = [pa.array(np.full(m, x, t)) for x, t in ((part.column(1)[row].as_py(), np.int64), (n.bit_length(), np.int32), (least_hits(n, percent), np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sketch.view(np.int64))], ["item", "class", "need", "number"])

    sketch, used = written(texts.select("text", "item").mapInArrow(tidy(sketched), "item long, class int, need long, number long"), "sketches")
    # unsigned order by flipping the top bit; as many rows as sizes have binary digits
    bounds = {r["class"]: np.uint64(r["top"] + (1 << 63)) for r in sketch.groupBy("class").agg(F.max(F.expr("number ^ (-9223372036854775807L - 1)")).alias("top")).collect()}

    def signed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, made, begin in _numbers(lowered(part.column(1)), k):
                ids, place = part.column(0).slice(first, len(begin) - 1), part.column(2).slice(first, len(begin) - 1)
                row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                for c, bound in bounds.items():
                    own = made <= bound
                    two = np.unique(np.stack([row[own].astype(np.uint64), made[own]]), axis=1)
                    at = pa.array(two[0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([ids.take(at), place.take(at), pa.array(np.full(two.shape[1], c, np.int32)), pa.array(two[1].view(np.int64))], ["doc_id", "place", "class", "number"])

    placed = docs.withColumn("place", F.xxhash64("text"))
    signature, beside = written(placed.mapInArrow(tidy(signed), "doc_id long, place long, class int, number long"), "signatures")
    hits = spread_join(signature, sketch, ["class", "number"])
    # rows that repeat an id and a text count double here, which only makes more candidates
    pairs = hits.groupBy("doc_id", "place", "item").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("doc_id", "place", "item")
    pairs, _ = written(pairs, "candidates")
    for path in (used, beside):
        remove(spark, path)
    own = placed.withColumnsRenamed({"doc_id": "d", "place": "p", "text": "t"})
    both, _ = written(pairs.join(own, pairs["doc_id"].eqNullSafe(F.col("d")) & (pairs["place"] == F.col("p"))).select("doc_id", "item", "t"), "candidates")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            t, text = lowered(part.column(2)), lowered(part.column(3))
            for i in range(part.num_rows):
                exact = exact_shingles(_words(text[i].as_py().encode()), k)
                shared = len(exact & exact_shingles(_words(t[i].as_py().encode()), k))
                if 100 * shared >= percent * len(exact):
                    out.append((part.column(0)[i].as_py(), part.column(1)[i].as_py(), shared, len(exact), shared / len(exact)))
            yield _batch(out)

    found = spread_join(both, texts, ["item"]).select("doc_id", "item", "t", "text").mapInArrow(tidy(verify), RESULT)
    found, _ = written(found.withColumnRenamed("item_id", "item"), "found")
    names = items.distinct().join(texts, "text").select("item_id", "item")
    return spread_join(found, names, ["item"]).select(*_NAMES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, by_text: bool = False) -> DataFrame:
    """The documents that contain no test item, with all their columns; those without an id stay.

    With ``by_text`` the decision is carried by a 64-bit hash of the text and not by the id: each row goes or stays by its
    own text, also without an id or with one that repeats.
    """
    own = F.xxhash64("text") if by_text else F.col("doc_id").cast("long")
    leaks = contaminated(docs.select(own.alias("doc_id"), "text"), benchmark, k, percent).select(F.col("doc_id").alias("_lx_id")).distinct()
    return docs.join(leaks, own == F.col("_lx_id"), "left_anti")
