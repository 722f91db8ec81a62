"""Which words abbreviate which: long words walk through a trie of short ones, all at once.

A short word's letters occur in the long one in order, from the first on. The walk takes each letter where it comes next, so it
reaches every word that a long one holds once, and nothing that no word begins with: work follows what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import dealt

#: Long words of a task's group, at most about.
LONGS = 4000


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as a matrix, padded by zeros, and their lengths."""
    size = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(size.max(initial=1))), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def trie(rows: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(child by node and letter, node of each row) of distinct sorted rows of letters 1..kinds - 1, ended by zeros. Node 0 is the root."""
    n, m = rows.shape
    differs = np.ones((n, m), bool)
    differs[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    new = differs & (rows > 0)
    ids = np.cumsum(new.ravel()).reshape(n, m)
    node = np.maximum.accumulate(np.where(new, ids, 0), axis=0)
    parent = np.concatenate([np.zeros((n, 1), int), node[:, :-1]], axis=1)
    child = np.zeros((int(new.sum()) + 1, kinds), np.int32)
    child[parent[new], rows[new]] = node[new]
    return child, node[np.arange(n), (rows > 0).sum(axis=1) - 1]


def matches(shorts: list[str], longs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(short, long, class) by place in the lists of lower-case words: 0 if the short one, of a letter at least, is a proper
    prefix, 1 if it is shorter, has two letters and a third of the length, and its letters are in the long one in order, from the first on."""
    empty = np.zeros(0, int)
    if not shorts or not longs:
        return empty, empty, empty
    words = sorted(set(shorts))
    place = {w: i for i, w in enumerate(words)}
    of = np.array([place[w] for w in shorts])
    by = np.argsort(of, kind="stable")
    start = np.searchsorted(of[by], np.arange(len(words) + 1))
    a, _ = letters(words)
    b, size = letters(longs)
    known, coded = np.unique(a, return_inverse=True)
    if known[0]:
        known, coded = np.concatenate([[0], known]), coded + 1
    child, ends = trie(coded.reshape(a.shape), len(known) + 1)
    word = np.full(len(child), -1)
    word[ends] = np.arange(len(words))
    at = np.minimum(np.searchsorted(known, b), len(known) - 1)
    code = np.where(known[at] == b, at, len(known))  # a letter that no short word has leads nowhere
    before = np.full(b.shape, -1, np.int16)
    for j in range(1, b.shape[1]):
        for i in range(j):
            before[b[:, j] == b[:, i], j] = i
    first = child[0, code[:, 0]]
    row = np.flatnonzero(first)
    node, last, depth = first[row], np.zeros(len(row), np.int16), np.ones(len(row), np.int16)
    for j in range(1, b.shape[1]):
        go = np.flatnonzero((before[row, j] <= last) & (j < size[row]))
        to = child[node[go], code[row[go], j]]
        go, to = go[to > 0], to[to > 0]
        row, node, last, depth = np.concatenate([row, row[go]]), np.concatenate([node, to]), np.concatenate([last, np.full(len(go), j, np.int16)]), np.concatenate([depth, depth[go] + np.int16(1)])
    begins = last == depth - 1
    hit = (word[node] >= 0) & (depth < size[row]) & (begins | (depth >= 2) & (3 * depth.astype(int) >= size[row]))
    w, row, kind = word[node[hit]], row[hit], np.where(begins[hit], 0, 1)
    many = start[w + 1] - start[w]
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return by[np.repeat(start[w], many) + offset], np.repeat(row, many), np.repeat(kind, many)


def pairs(words: DataFrame, shortest: int = 1, best: bool = False, longs: int = LONGS) -> DataFrame:
    """(short, long, class) for distinct words (canonical) of which one abbreviates another; of each short word in a group only
    the first by class, length and name if ``best``.

    Groups are the first two letters of short words, with the long words that have them in order, dealt over tasks.
    """
    w = words.select("canonical").distinct().where(F.length("canonical") > 0).withColumn("low", F.lower("canonical"))
    size, letter = F.length("low"), lambda i: F.substring(F.col("low"), i, F.lit(1))
    one = F.length("canonical") >= shortest
    short = w.where(one & (size >= 2)).select(F.substring("low", 1, 2).alias("k"), F.col("canonical").alias("s"), F.col("low").alias("sl"))
    keys = F.array_distinct(F.transform(F.sequence(F.lit(2), size), lambda i: F.concat(letter(F.lit(1)), letter(i))))
    long = w.where(size >= 3).select(F.explode(keys).alias("k"), F.col("canonical").alias("l"), F.col("low").alias("ll"))
    sizes = long.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / longs).cast("int").alias("pieces")).join(short.select("k").distinct(), "k", "left_semi")
    from .graph import settled, small

    sizes = small(settled(sizes))
    left = short.join(sizes, "k").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    right = long.join(sizes.drop("n"), "k").withColumn("piece", F.pmod(F.xxhash64("l"), F.col("pieces")).cast("int"))
    groups = int(sizes.agg(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / longs)).first()[0])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, kind = matches(a["sl"].to_pylist(), b["ll"].to_pylist())
        if best and len(i):
            name = b["l"].to_pylist()
            rank = np.empty(len(name), int)
            rank[sorted(range(len(name)), key=lambda x: (len(name[x]), name[x]))] = np.arange(len(name))
            by = np.lexsort((rank[j], kind, i))
            by = by[np.unique(i[by], return_index=True)[1]]
            i, j, kind = i[by], j[by], kind[by]
        return pa.table({"short": a["s"].combine_chunks().take(pa.array(i)), "long": b["l"].combine_chunks().take(pa.array(j)), "class": pa.array(kind, pa.int32())})

    left, right = dealt(left.select("k", "piece", "s", "sl"), ["k", "piece"], groups), dealt(right.select("k", "piece", "l", "ll"), ["k", "piece"], groups)
    met = left.groupBy("k", "piece").cogroup(right.groupBy("k", "piece")).applyInArrow(meet, "short string, long string, class int")
    if shortest > 1:
        return met
    # a letter is a prefix only: of all longer words that it begins
    single = w.where(one & (size == 1)).select(F.col("canonical").alias("short"), F.col("low").alias("k"))
    begun = w.where(size > 1).select(F.substring("low", 1, 1).alias("k"), F.col("canonical").alias("long"))
    if best:
        begun = begun.groupBy("k").agg(F.min(F.struct(F.length("long"), "long"))["long"].alias("long"))
    return met.unionByName(begun.join(single, "k").select("short", "long", F.lit(0).alias("class")))
