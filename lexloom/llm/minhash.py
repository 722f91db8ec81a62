"""Near-duplicate detection: one-permutation MinHash, optimal densification, banded buckets, stars.

1. Each text becomes the set of its word shingles; one permutation (the shingle's 64-bit number)
   is cut into bins by its top bits, a bin's least number is its component, and an empty bin borrows
   from a bin drawn by a 2-universal sequence of its own (optimal densification).
2. Documents with equal sets collapse to one representative, so groups of copies cost one row; a digest finds them and the
   full sets confirm them.
3. Bands of ``ROWS`` bins are buckets. A bucket's members get one edge each, to the member that has
   most company (a star), never all pairs. Edges are confirmed on the full sets.
4. A star can miss a link between two of its rays. Where a bucket's members are still in different
   components, another star is drawn around a component that has had none, and what is left is compared
   by sketches (the least ``SKETCH`` numbers of a set; most sets whole), in blocks of bounded size inside a
   task: no pair becomes a row unless its sketches allow a link. Where over ``LARGE`` members are left, they meet only
   where they share one of the first shingles of both, common ones coming last. So no link of a shared bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, slices, spread_join, tidy, utf8, written
from .components import components
from .words import byte_words, exact_shingles, mix, shingle_rows, words

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Tables of up to so many rows of two longs are broadcast.
BROADCAST_ROWS = 200_000
#: Stars drawn before what is left is compared by sketches.
STARS = 2
SKETCH, BLOCK = 512, 512
#: Members of a bucket up to which blocks meet two by two, so that a sketch is copied LARGE / BLOCK times at most.
LARGE = 16 * BLOCK
#: Shingles that count as common, at most (8 bytes each, broadcast).
MOST_COMMON = 2_000_000

_BIN_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
_DONORS = (mix(np.arange(BINS * 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 64)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of sorted distinct shingle numbers (at least one)."""
    at = np.searchsorted(found, _BIN_EDGES)
    full = at < np.append(at[1:], len(found))
    out = np.where(full, found[np.minimum(at, len(found) - 1)], np.uint64(0))
    empty = np.flatnonzero(~full)
    for turn in range(_DONORS.shape[1]):
        if not len(empty):
            return out
        donor = _DONORS[empty, turn]
        ok = full[donor]
        # what is borrowed depends on the turn too, so that a borrowed value matches only if borrowed alike
        out[empty[ok]] = out[donor[ok]] + np.uint64(turn + 1)
        empty = empty[~ok]
    if len(empty):  # all draws hit empty bins: the least number of the set serves
        out[empty] = found[0]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS)
    out = _BAND_SALT.copy()
    for j in range(ROWS):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + rows[:, j])
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, bands): hi and lo are a 128-bit hash of the set; null without words."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, at = utf8(part.column(1))
            for low, high in slices(at):
                number, first = words(raw[at[low] : at[high]], at[low : high + 1] - at[low])
                made, begin = shingle_rows(number, first, k)
                counts, keys, sigs = [], [], []
                for i in range(high - low):
                    found = np.sort(made[begin[i] : begin[i + 1]])
                    if len(found):
                        found = found[np.append(True, found[1:] != found[:-1])]
                        sigs.append(bands(signature(found)))
                        keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    counts.append(len(found))
                n = np.array(counts, np.int64)
                none = n == 0
                two = np.zeros((high - low, 2), np.int64)
                two[~none] = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                offsets = np.append(0, np.cumsum(np.where(none, 0, BANDS))).astype(np.int32)
                flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(low, high - low).cast(pa.int64()), pa.array(n), pa.array(two[:, 0], mask=none), pa.array(two[:, 1], mask=none), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["doc_id", "n_shingles", "hi", "lo", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(rows), "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union, written.

    texts: (id, text), read for documents in pairs only. A pair's two texts meet in one row, and the pairs of an id in
    many of them are dealt over many tasks, so no task gathers the members of a star.
    """
    spark = pairs.sparkSession
    pairs, at = written(pairs, "pairs")
    total = pairs.count()
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # few ids: their texts are fetched by a broadcast of the ids, so that the other texts are not shuffled
    used, beside = written(texts.join(_small(ids, 2 * total), "id", "left_semi"), "texts")
    left = used.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = used.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    often = lambda x: pairs.groupBy(x).agg(F.count(F.lit(1)).alias("rows"))
    both = spread_join(pairs, right, ["b"], often("b"))
    both = spread_join(both, left, ["a"], often("a"), total=total, by=["a", "b"]).select("a", "b", "ta", "tb")

    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine, known = None, [], set()
        for part in parts:
            a, b, keep = part.column(0).to_pylist(), part.column(1).to_pylist(), []
            for i in range(part.num_rows):
                if a[i] != last:  # the join leaves rows in runs of a
                    last, mine, known = a[i], byte_words(part.column(2)[i].as_py()), None
                words_b = byte_words(part.column(3)[i].as_py())
                if mine == words_b:  # equal sequences have equal sets
                    keep.append(len(mine) > 0)
                    continue
                known = exact_shingles(mine, k) if known is None else known
                other = exact_shingles(words_b, k)
                shared = len(known & other)
                keep.append(100 * shared >= percent * (len(known) + len(other) - shared) and shared > 0)
            mask = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[mask]), pa.array(np.array(b, np.int64)[mask])], ["a", "b"])

    found, _ = written(both.mapInArrow(tidy(linked), "a long, b long"), "links")
    for path in (at, beside):
        remove(spark, path)
    return found


def _least(parts: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, sketch): the least SKETCH of the upper halves of a set's numbers, sorted."""
    for part in parts:
        raw, at = utf8(part.column(1))
        for low, high in slices(at):
            number, first = words(raw[at[low] : at[high]], at[low : high + 1] - at[low])
            made, begin = shingle_rows(number, first, k)
            made = (made >> np.uint64(32)).astype("<u4")
            out = [np.unique(made[begin[i] : begin[i + 1]])[:SKETCH].tobytes() for i in range(high - low)]
            yield pa.RecordBatch.from_arrays([part.column(0).slice(low, high - low), pa.array(out, pa.binary())], ["id", "sketch"])


def possible(sketch: list[np.ndarray], home: np.ndarray, component: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows, of different components and one of them at home, whose sketches allow a link.

    Where sketches are whole sets the similarity is known, and only a forest of the links is given; else it is
    sampled below the least end of a cut sketch, and all within seven deviations are given.
    """
    m, least = len(sketch), percent / 100
    whole = np.array([len(x) < SKETCH for x in sketch])
    top = min((int(x[-1]) for x, w in zip(sketch, whole, strict=True) if not w), default=1 << 32)
    flat = np.concatenate(sketch)
    row = np.repeat(np.arange(m), [len(x) for x in sketch])
    row, flat = row[flat <= top], flat[flat <= top]
    size = np.bincount(row, minlength=m).astype(np.float32)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    both = np.zeros((m, m), np.float32)
    often = count > 1  # what one row has alone is in no intersection
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        i, j = np.searchsorted(column, (low, low + 4096))
        matrix = np.zeros((m, min(4096, int(place[-1]) + 1 - low)), np.float32)
        matrix[row[i:j], column[i:j] - low] = 1
        both += matrix @ matrix.T
    union = size[:, None] + size[None, :] - both
    near = both / np.maximum(union, 1)
    sampled = top < 1 << 32
    slack = 7 * np.sqrt(least * (1 - least) / np.maximum(union, 1)) if sampled else 0.01
    ok = np.triu(near >= least - slack, 1) & (component[:, None] != component[None, :]) & (home[:, None] | home[None, :])
    if block.min() != block.max():
        ok &= block[:, None] != block[None, :]  # those of one block meet in its own group
    a, b = np.nonzero(ok)
    if sampled:
        return list(zip(a.tolist(), b.tolist(), strict=True))
    parent = {c: c for c in component.tolist()}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i in np.argsort(-near[a, b], kind="stable").tolist():
        x, y = root(component[a[i]].item()), root(component[b[i]].item())
        if x != y or near[a[i], b[i]] < least + 0.01:  # a doubtful one joins nothing before it is confirmed
            out.append((int(a[i]), int(b[i])))
            if near[a[i], b[i]] >= least + 0.01:
                parent[x] = y
    return out


def _sets(parts: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows (id, text, ...) with each text's distinct shingle numbers, sorted."""
    for part in parts:
        raw, at = utf8(part.column(1))
        for low, high in slices(at):
            number, first = words(raw[at[low] : at[high]], at[low : high + 1] - at[low])
            made, begin = shingle_rows(number, first, k)
            yield part.slice(low, high - low), [np.unique(made[begin[i] : begin[i + 1]]) for i in range(high - low)]


def prefix_of(found: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent % of n) + 1 numbers of a sorted set, those that are not in ``common`` (sorted) before the others."""
    place = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
    late = common[place] == found if len(common) else np.zeros(len(found), bool)
    ordered = np.concatenate([found[~late], found[late]])
    return ordered[: len(found) - (percent * len(found) + 99) // 100 + 1]


def refined(pending: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pending, where the members of buckets of over LARGE meet by rare shingles instead.

    In any one order of all shingles, the first that two linked sets of n and m share is among the first n - ceil(percent % of n) + 1
    of the one, and likewise of the other, as each shares percent % at least. The order has those that many
    members have last, so what makes members alike without linking them (a frame that all pages of a site share) brings
    no two together. A set's shingles become rows once, to be counted, and the first of them once more, however many
    buckets it is in.
    """
    spark = pending.sparkSession
    large, _ = written(pending.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > LARGE), "large")
    if large.isEmpty():
        return pending
    # at most one in LARGE of pending's rows
    few = _small(large.select("bucket"), large.count())
    inside, _ = written(spread_join(pending, large.select("bucket"), ["bucket"], large, "left_semi").select("id", "component").distinct(), "large")
    own, _ = written(texts.join(_small(inside, inside.count()), "id").select("id", "text", "component"), "texts")

    def all_numbers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(parts, k):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["number"])

    often, _ = written(own.mapInArrow(tidy(all_numbers), "number long").groupBy("number").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK), "often")
    least = BLOCK
    while often.where(F.col("rows") > least).count() > MOST_COMMON:  # any order will do; with fewer common ones more sets meet
        least *= 2
    common = spark.sparkContext.broadcast(np.sort(np.array([r.number for r in often.where(F.col("rows") > least).toLocalIterator()], np.int64).view(np.uint64)))

    def rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(parts, k):
            firsts = [prefix_of(x, common.value, percent) for x in sets]
            many = [len(x) for x in firsts]
            row = pa.array(np.repeat(np.arange(len(sets)), many))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), part.column(0).take(row), pa.array(np.repeat([len(x) for x in sets], many)), part.column(2).take(row)], ["bucket", "id", "n", "component"])

    cut, _ = written(own.mapInArrow(tidy(rare), "bucket long, id long, n long, component long"), "rare")
    # near copies share many rare shingles: of buckets with the same members one is enough
    who = F.xxhash64("id", "n")
    members = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(who).alias("x"), F.sum(F.col("id").cast("decimal(38,0)")).alias("y"), F.bit_xor(F.xxhash64(who, "n")).alias("z")).where("rows > 1")
    kept, _ = written(members.groupBy("rows", "x", "y", "z").agg(F.min("bucket").alias("bucket")).select("bucket", "rows"), "kept")
    cut = spread_join(cut, kept.select("bucket"), ["bucket"], kept, "left_semi")
    rest = spread_join(pending, few, ["bucket"], large, "left_anti").select("bucket", "id", "n", "component")
    return written(rest.unionByName(cut), "refined")[0]


def left_over(pending: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that sketches allow among the members (bucket, id, n, component) of buckets of several components.

    Sets that can be linked are of one size class or of neighbouring ones, so a bucket is cut by class, each row
    being at home in its own and a guest in the next; groups of more than BLOCK rows are cut into blocks that
    meet two by two.
    """
    pending = refined(pending, texts, k, percent)
    ids = pending.select("id").distinct()
    few = _small(ids, ids.count())
    sketch, _ = written(texts.join(few, "id", "left_semi").mapInArrow(tidy(lambda parts: _least(parts, k)), "id long, sketch binary").distinct(), "sketches")
    step = float(np.log(100 / percent) * (1 + 1e-9)) if percent < 100 else 1e-9
    own = F.floor(F.log("n") / F.lit(step))
    rows, _ = written(pending.select("bucket", "id", "component", F.explode(F.array(F.struct(own.alias("class"), F.lit(True).alias("home")), F.struct((own + 1).alias("class"), F.lit(False).alias("home")))).alias("c")).select("bucket", "id", "component", "c.class", "c.home"), "classes")
    size, _ = written(rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("x"), F.max("component").alias("y"), F.max("home").alias("any")).where("x < y and any").select("bucket", "class", "rows"), "sizes")
    cut = spread_join(rows, size, ["bucket", "class"], size).withColumn("blocks", F.ceil(F.col("rows") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cut = cut.join(sketch, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["bucket", "class", "p", "q"]
    cut = cut.select("bucket", "class", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "component", "home", "block", "sketch")
    dealt = cut.repartition(*keys).sortWithinPartitions(*keys)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def group(table: pa.Table) -> list[tuple[int, int]]:
            ids = table["id"].to_numpy()
            found = possible([np.frombuffer(x, "<u4") for x in table["sketch"].to_pylist()], np.array(table["home"].to_pylist(), bool), table["component"].to_numpy(), table["block"].to_numpy(), percent)
            return [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in found if ids[i] != ids[j]]

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            two = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], ["a", "b"])

        key = None
        for part in parts:
            marks = np.stack([part.column(i).to_numpy() for i in range(4)])
            starts = np.append(0, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1) if part.num_rows else np.zeros(0, int)
            pairs: list[tuple[int, int]] = []
            for i, low in enumerate(starts):
                high = starts[i + 1] if i + 1 < len(starts) else part.num_rows
                mine = tuple(marks[:, low])
                if mine != key and held:
                    pairs += group(pa.Table.from_batches(held))
                    held = []
                key = mine
                held.append(part.slice(low, high - low))
            yield out(pairs)
        if held:
            yield out(group(pa.Table.from_batches(held)))

    return dealt.mapInArrow(tidy(compare), "a long, b long").distinct()


def links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and edges (a, b) of ids that connect exactly the linked documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig, _ = written(sketches(docs, k), "signatures")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    same = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    same, beside = written(same, "same")
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    copies = spread_join(known.select("doc_id", "hi", "lo"), same.select("hi", "lo", "rep"), ["hi", "lo"], same.select("hi", "lo", "rows")).where("doc_id <> rep")
    alike, at = written(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), "hi", "lo").distinct(), "alike")
    copies = confirmed(alike.select("a", "b").distinct(), texts, k, 100)
    # the representatives go on; with them, should a digest ever have erred, what the full sets do not confirm
    done, _ = written(alike.join(copies, ["a", "b"], "left_semi").select(F.col("b").alias("doc_id"), "hi", "lo"), "done")
    for path in (beside, at):
        remove(spark, path)
    others = known.join(_small(done, done.count()), ["doc_id", "hi", "lo"], "left_anti")
    buckets = others.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode(F.array_distinct("bands")).alias("bucket"))
    shared, _ = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("company")).where("company > 1"), "shared")
    company = shared.select("bucket", F.col("company").alias("rows"))
    # only what shares a bucket goes on; weight: how many it meets in all its buckets
    first, old = written(spread_join(buckets, shared, ["bucket"], company, total=BANDS * sig.count()), "members")
    weight = first.groupBy("id").agg(F.sum("company").alias("weight"))
    members, _ = written(first.select("id", "n", "bucket").join(weight, "id"), "members")
    remove(spark, old)
    edges, had = [copies], None
    label = members.withColumn("component", F.col("id"))
    for turn in range(STARS):
        # the member with most company, of a component that has not had the bucket's centre
        free = label if had is None else spread_join(label, had, ["bucket", "component"], how="left_anti")
        best = free.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("low"), "component", "n")).alias("best"))
        best, _ = written(best.select("bucket", (-F.col("best.low")).alias("centre"), F.col("best.component").alias("of"), F.col("best.n").alias("m")), "centres")
        star = spread_join(label, best, ["bucket"], company).where("component <> of").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(F.greatest("centre", "id").alias("a"), F.least("centre", "id").alias("b")).distinct()
        edges.append(confirmed(star, texts, k, percent))
        part = components(reduce(DataFrame.unionByName, edges[1:]))
        label = members.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = label.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        label, _ = written(spread_join(label, mixed.select("bucket"), ["bucket"], company, "left_semi", label.count()), "pending")
        # components of the centres as they are now
        at = label.join(best.select("bucket", F.col("centre").alias("id")), ["bucket", "id"], "left_semi").select("bucket", "component").distinct()
        had = at
        if label.isEmpty():
            return sig, reduce(DataFrame.unionByName, edges)
    edges.append(confirmed(left_over(label, texts, k, percent), texts, k, percent))
    return sig, reduce(DataFrame.unionByName, edges)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, sets distinct shingles of k words; fewer
    words make one shingle, a text without words (null, empty) has the empty set and is linked with
    nothing. Documents are linked when 100 * intersection >= percent * union. component_id is the
    least doc_id reachable, kept tells whether it is the document's own. Rows that share a doc_id are one
    node. A row without a doc_id is linked with nothing: component_id null, kept true. Other columns are
    ignored; an empty table gives an empty result.
    """
    sig, edges = links(docs, k, percent)
    found = components(edges)
    found, _ = written(found, "components")
    out = sig.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which near_duplicates keeps the id, with all their columns."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_lx_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_lx_id"), "left_anti")
