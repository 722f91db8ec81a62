"""Clusters of vectors: average linkage, labels, cross-reference, neighbours, diverse selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from . import tiles
from .graph import dropped, label_propagation, settled


#: Vectors of a tile: the graph of close pairs is found tile by tile.
TILE = 2048
#: Rows up to which components are found and merged each in a task; more are first merged in rounds by all tasks. Rows of a round's tile.
MANY, ROUND_TILE = 8192, 4096


def average_linkage(vectors: np.ndarray, threshold: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Labels in input order of unit vectors: the closest two clusters merge while their mean cosine distance is below
    ``threshold``; weights are the sizes that rows begin with.

    The mean distance of two clusters of unit vectors is 1 less the product of their mean vectors, so no matrix of
    distances is held: memory grows with the rows. Merges are found along chains of nearest neighbours, which gives the same
    clusters as taking the closest pair each time, as the mean distance of a merged cluster to a third lies between
    those of its parts. Ties go to the first row.
    """
    n = len(vectors)
    size = np.ones(n) if weights is None else weights.astype(float)
    mean = vectors.astype(float).copy()
    parent = np.arange(n)
    alive = np.ones(n, bool)
    chain: list[int] = []
    start = 0
    while True:
        if not chain:
            while start < n and not alive[start]:
                start += 1
            if start == n:
                break
            chain.append(start)
        top = chain[-1]
        d = 1 - mean @ mean[top]
        d[~alive] = np.inf
        d[top] = np.inf
        near = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[near]:
            near = chain[-2]
        if not d[near] < threshold:  # nothing that is close to it is left, nor will be: it is done, with all it may yet be compared with
            alive[top] = False
            chain.pop()
            continue
        if len(chain) > 1 and near == chain[-2]:
            i, j = min(top, near), max(top, near)
            mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
            size[i] += size[j]
            alive[j], parent[j] = False, i
            del chain[-2:]
        else:
            chain.append(near)
    for i in range(n):  # parents come first
        parent[i] = parent[parent[i]]
    return np.unique(parent, return_inverse=True)[1]


def close_forest(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of rows of the tiles a and b (the same object for one tile) that connect all that pairs with a product over
    ``least`` connect: fewer than there are rows."""
    near = a @ b.T > least
    if a is b:
        np.fill_diagonal(near, False)
    out, seen_a, seen_b = [], np.zeros(len(a), bool), np.zeros(len(b), bool)
    for root in range(len(a)):
        if seen_a[root] or not near[root].any():
            continue
        seen_a[root] = True
        queue = [(root, 0)]
        while queue:
            i, side = queue.pop()
            row, seen = (near[i], seen_b) if side == 0 else (near[:, i], seen_a)
            for j in np.flatnonzero(row & ~seen).tolist():
                seen[j] = True
                out.append((i, j) if side == 0 else (j, i))
                queue.append((j, 1 - side))
    return out


def close_pairs(heads: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(g, a, b): pairs of (id, u) at a distance below ``threshold``, enough of them to connect what all connect.

    Rows are dealt to tiles, and two tiles meet in one task as matrices; a row goes to as many tasks as there are tiles.
    """
    tiles = max(1, -(-heads.count() // tile))
    own = heads.withColumn("t", F.pmod(F.xxhash64("id"), F.lit(tiles)))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).select(F.least("t", "other").alias("p"), F.greatest("t", "other").alias("q"), "t", "id", "u")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows["p"].iloc[0], rows["q"].iloc[0]
        halves = [(h["id"].to_numpy(), np.stack(h["u"].to_numpy())) for h in (rows[rows["t"] == p], rows[rows["t"] == q]) if len(h)]
        if p != q and len(halves) < 2:
            return pd.DataFrame({"g": [], "a": [], "b": []})
        (ia, a), (ib, b) = halves[0], halves[-1]
        pairs = close_forest(a, a if p == q else b, 1 - threshold)
        return pd.DataFrame({"g": 0, "a": [ia[i] for i, _ in pairs], "b": [ib[j] for _, j in pairs]})

    return dealt.groupBy("p", "q").applyInPandas(meet, "g int, a long, b long")


def nearest_each(rows: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(id, d, near): the nearest other row of each of (id, u), at a distance of 1 less the product; ties go to the lesser id. Rows that
    have nothing closer than ``threshold`` are left out. Two tiles meet in one task, a slice of products at a time."""
    n = max(1, -(-rows.count() // tile))
    own = rows.select("id", "u", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("t")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    spread = own.select(F.least("t", "other").alias("p"), F.greatest("t", "other").alias("q"), "t", "id", "u")

    def meet(table: pa.Table) -> pa.Table:
        t, p, q = table["t"].to_numpy(), table["p"][0].as_py(), table["q"][0].as_py()
        ids, (m, _) = table["id"].to_numpy(), tiles.matrix(table["u"])
        (ia, a), (ib, b) = ((ids[x][o := np.argsort(ids[x])], m[x][o]) for x in (np.flatnonzero(t == p), np.flatnonzero(t == q)))
        found = []
        if len(a) and len(b):
            low, at = np.full(len(b), np.inf), np.zeros(len(b), int)
            for i in range(0, len(a), 512):
                d = 1 - a[i : i + 512] @ b.T
                if p == q:
                    d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
                j = d.argmin(axis=1)
                found.append((ia[i : i + 512], d[np.arange(len(d)), j], ib[j]))
                if p != q:
                    k = d.argmin(axis=0)
                    best = d[k, np.arange(len(b))]
                    at, low = np.where(best < low, k + i, at), np.minimum(best, low)
            if p != q:
                found.append((ib, low, ia[at]))
        one, d, near = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        keep = d < threshold
        return pa.table({"id": pa.array(one[keep], pa.int64()), "d": d[keep], "near": pa.array(near[keep], pa.int64())})

    met = tiles.dealt(spread, ["p", "q"], n * (n + 1) // 2).groupBy("p", "q").applyInArrow(meet, "id long, d double, near long")
    return met.groupBy("id").agg(F.min(F.struct("d", "near")).alias("m")).select("id", "m.d", "m.near")


def merge_rounds(heads: DataFrame, threshold: float, many: int = MANY, tile: int = ROUND_TILE) -> tuple[DataFrame, list[DataFrame]]:
    """Clusters (id, u, n) that are still to merge, ``many`` at most, and the merges (a, b) that led to them.

    A round finds the nearest of every cluster and merges all pairs that are each other's nearest: as the mean distance of a merged
    cluster to a third lies between those of its parts, they would merge in any order. What has nothing near it is done.
    """
    merges, rows = [], heads.select("id", "u", F.col("n").cast("double").alias("n"))
    while rows.count() > many:
        near = settled(nearest_each(rows, threshold, tile))
        back = near.select(F.col("id").alias("near"), F.col("near").alias("id"))
        pairs = settled(near.select("id", "near").join(back, ["id", "near"]).where("id < near").select(F.col("id").alias("a"), F.col("near").alias("b")))
        merges.append(pairs)
        live = rows.join(near.select("id"), "id", "left_semi").join(pairs.select(F.col("b").alias("id")), "id", "left_anti")
        other = rows.select(F.col("id").alias("b"), F.col("u").alias("v"), F.col("n").alias("m"))
        met = live.join(pairs.withColumnRenamed("a", "id"), "id", "left").join(other, "b", "left")
        mean = F.zip_with("u", "v", lambda x, y: (x * F.col("n") + y * F.col("m")) / (F.col("n") + F.col("m")))
        new = settled(met.select("id", F.when(F.col("b").isNull(), F.col("u")).otherwise(mean).alias("u"), (F.col("n") + F.coalesce("m", F.lit(0.0))).alias("n")))
        dropped(near)
        if len(merges) > 1:
            dropped(rows)
        rows = new
    return rows, merges


def cluster(vectors: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(id, label) of vectors (id, vector) by average linkage at a cosine distance below ``threshold``.

    Clusters never span components of the graph of pairs closer than the threshold (a mean below it needs a pair
    below it), so each component is clustered by itself, in memory that grows with its vectors. A row without a
    vector, or with a zero one, is alone. label is the least id of the cluster.
    """
    u = vectors.select("id", unit(F.col("vector")).alias("u"))
    usable = settled(u.where(F.col("u").isNotNull() & (F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x) > 0.5)))
    # equal vectors merge at distance 0 before all others: one row with their number stands for them
    heads = settled(usable.groupBy("u").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    rest, merges = merge_rounds(heads, threshold)
    comp = label_propagation(close_pairs(rest.select("id", "u"), threshold, tile), "g").select(F.col("node").alias("id"), "component")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        label = average_linkage(np.stack(rows["u"].to_numpy()), threshold, rows["n"].to_numpy())
        ids = rows["id"].to_numpy()
        first = {x: ids[label == x].min() for x in set(label)}
        return pd.DataFrame({"id": ids, "label": [first[x] for x in label]})

    grouped = rest.join(comp, "id").groupBy("component").applyInPandas(merge, "id long, label long")
    if merges:
        linked = reduce(DataFrame.unionByName, [*merges, settled(grouped).select(F.col("id").alias("a"), F.col("label").alias("b"))])
        grouped = label_propagation(linked.withColumn("g", F.lit(0)), "g").select(F.col("node").alias("id"), F.col("component").alias("label"))
    by_head = heads.join(grouped, "id", "left").select("u", F.coalesce("label", "id").alias("label"))
    return vectors.select("id").join(usable.join(by_head, "u").select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(query_id, id, score): the ``k`` nearest others by cosine of each query (id, vector); ties go to the lesser id.

    Vectors meet queries as matrices, block by block; each task keeps its own best k before any shuffle.
    """
    q = queries.select(F.col("id").alias("query_id"), unit(F.col("vector")).alias("uq"))
    v = vectors.select("id", unit(F.col("vector")).alias("u"))
    scored = tiles.nearest(q, v, k)
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def cluster_labels(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(label, behaviour): the most frequent callee (entity, callee) of a cluster's members (entity, label); ties by name, none: null."""
    n = members.join(calls, "entity").groupBy("label", "callee").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("label").agg(F.min_by("callee", F.struct(-F.col("n"), "callee")).alias("behaviour"))
    return members.select("label").distinct().join(best, "label", "left")


def cross_reference(a: DataFrame, b: DataFrame, least: float = 0.1) -> DataFrame:
    """(a, b, jaccard) of two clusterings (id, a) and (id, b) of the same things. Each size is an aggregate; only overlaps are joined."""
    both = a.join(b, "id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    na, nb = a.groupBy("a").agg(F.count(F.lit(1)).alias("na")), b.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard")).where(F.col("jaccard") >= least)


def nearest_centroid(vectors: DataFrame, cents: DataFrame) -> DataFrame:
    """(id, label, score) of the most similar centroid (label, centroid); ties by label. Centroids are as few as clusters."""
    c = cents.select("label", unit(F.col("centroid")).alias("uc"))
    scored = vectors.select("id", unit(F.col("vector")).alias("u")).crossJoin(F.broadcast(c)).select("id", "label", F.round(dot(F.col("u"), F.col("uc")), 9).alias("score"))
    return scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("m")).select("id", F.col("m.label").alias("label"), (-F.col("m.s")).alias("score"))


def diverse(entities: DataFrame, k: int) -> DataFrame:
    """The first k of entities (id, kind, density, label) taken from clusters in turn.

    Inside a cluster: other kinds before methods, then by density; clusters by size; those without a cluster last in each turn.
    """
    inside = Window.partitionBy("label").orderBy((F.col("kind") == "method").cast("int"), F.desc("density"), "id")
    size = Window.partitionBy("label")
    ranked = entities.withColumn("turn", F.row_number().over(inside)).withColumn("size", F.when(F.col("label").isNotNull(), F.count(F.lit(1)).over(size)).otherwise(0))
    return ranked.orderBy("turn", F.col("label").isNull().cast("int"), F.desc("size"), "label").limit(k)
