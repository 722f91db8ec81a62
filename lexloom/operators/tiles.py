"""Products of unit vectors tile by tile: what is quadratic by nature, in bounded memory and dealt over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile. Two tiles make a million pairs at most or so.
ROWS = 1024
#: Rows of a cluster up to which its pairs are joined by Spark; larger ones are met as tiles.
FEW = 64
#: Products held at once, and pairs scored exactly at once.
CELLS, EXACT = 4_000_000, 100_000


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of a matrix, short ones padded by zeros, and which rows are null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = column.is_null().to_numpy(zero_copy_only=False)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0)) if dim is None else dim
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width), null
    out = np.zeros((len(size), width))
    at = np.concatenate([[0], np.cumsum(size)])
    for i, n in enumerate(np.minimum(size, width)):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out, null


def dealt(rows: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """Rows by key over as many partitions as groups need, which are not put together again for having few bytes."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(max(least, groups), 4_000), *keys)


def cluster_pairs(u: DataFrame, rows: int = ROWS, few: int = FEW) -> DataFrame:
    """(source, target, weight) of all pairs source < target of (id, label, u) with the same label: the product of their u.

    A cluster's rows are dealt to tiles of about ``rows``, and two tiles meet in one task as matrices.
    """
    u = u.where("id is not null and label is not null")
    sizes = u.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("tiles"), F.count(F.lit(1)).alias("n"))
    groups = int(sizes.where(F.col("n") > few).agg(F.coalesce(F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2), F.lit(0))).first()[0])
    sized = u.join(sizes, "label")
    from ..functions.vectors import dot

    small = sized.where(F.col("n") <= few)
    a, b = small.select("label", F.col("id").alias("source"), F.col("u").alias("ua")), small.select("label", F.col("id").alias("target"), F.col("u").alias("ub"))
    joined = a.join(b, "label").where("source < target").select("source", "target", dot(F.col("ua"), F.col("ub")).alias("weight"))
    if not groups:
        return joined
    own = sized.where(F.col("n") > few).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("label", F.least("t", "other").alias("p"), F.greatest("t", "other").alias("q"), "t", "id", "u")
    ident = u.schema["id"].dataType

    def meet(table: pa.Table) -> pa.Table:
        t, p, q = table["t"].to_numpy(), table["p"][0].as_py(), table["q"][0].as_py()
        ids = table["id"].combine_chunks()
        m, null = matrix(table["u"])
        order = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]
        i, j = (np.flatnonzero(t == x) for x in (p, q))
        first, second = (x.ravel() for x in np.broadcast_arrays(i[:, None], j[None, :]))
        weight = (m[i] @ m[j].T).ravel()
        keep = order[first] < order[second] if p == q else order[first] != order[second]
        first, second, weight = first[keep], second[keep], weight[keep]
        turn = order[first] > order[second]
        first, second = np.where(turn, second, first), np.where(turn, first, second)
        return pa.table({"source": ids.take(pa.array(first)), "target": ids.take(pa.array(second)), "weight": pa.array(weight, mask=null[first] | null[second])})

    tiled = dealt(spread, ["label", "p", "q"], groups).groupBy("label", "p", "q").applyInArrow(meet, f"source {ident.simpleString()}, target {ident.simpleString()}, weight double")
    return joined.unionByName(tiled)


def best_of(ids: pa.Array, q: np.ndarray, at: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query q, row at, score s) the k first of each query by score, then by id."""
    order = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1] if len(ids) else np.zeros(0, int)
    by = np.lexsort((order[at], -s, q))
    q, at, s = q[by], at[by], s[by]
    start = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - start < k
    return q[keep], at[keep], s[keep]


def top(query_ids: pa.Array, queries: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch], k: int, cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score): of the rows (id, u) of all batches the k best for each query, other than itself.

    A block of products finds what may be among the best; such pairs are scored one by one, so that equal vectors score equal
    wherever they stand in a block. A null vector scores null, which comes last.
    """
    m, none = queries
    if not len(m):
        return
    step = max(1, cells // len(m))
    names = query_ids.to_pylist()
    bq, bs, bid = np.zeros(0, int), np.zeros(0), query_ids.slice(0, 0)
    floor = np.full(len(m), -np.inf)
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            v, null = matrix(part.column("u"), m.shape[1])
            ids = part.column("id")
            s = m @ v.T
            s[np.isnan(s)] = np.inf
            s[none, :] = -np.inf
            s[:, null] = -np.inf
            if len(ids) > k + 1:  # a query may be among the rows itself
                floor_here = np.maximum(floor, np.partition(s, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])
            else:
                floor_here = floor
            q, at = np.nonzero(s >= (floor_here - 1e-9)[:, None])
            rough = s[q, at]
            s = None
            exact = np.concatenate([np.zeros(0), *((m[q[x : x + EXACT]] * v[at[x : x + EXACT]]).sum(axis=1) for x in range(0, len(q), EXACT))])
            exact = np.where(np.isinf(rough), rough, exact)
            own = np.array(ids.to_pylist(), dtype=object)[at] != np.array(names, dtype=object)[q]
            q, at, exact = q[own.astype(bool)], at[own.astype(bool)], exact[own.astype(bool)]
            pool = pa.concat_arrays([bid, ids])
            bq, at, bs = best_of(pool, np.concatenate([bq, q]), np.concatenate([np.arange(len(bid)), at + len(bid)]), np.concatenate([bs, exact]), k)
            bid = pool.take(pa.array(at))
            full = np.bincount(bq, minlength=len(m)) >= k
            last = np.flatnonzero(np.diff(np.append(bq, -1)))
            floor[bq[last]] = np.where(full[bq[last]], bs[last], -np.inf)
    score = pa.array(np.where(np.isposinf(bs), np.nan, bs), mask=np.isneginf(bs))
    for low in range(0, len(bq), 10_000):
        yield pa.record_batch({"query_id": query_ids.take(pa.array(bq[low : low + 10_000])), "id": bid.slice(low, 10_000), "score": score.slice(low, 10_000)})


def nearest(q: DataFrame, v: DataFrame, k: int, few: int = 10_000, rows: int = 4 * ROWS) -> DataFrame:
    """(query_id, id, score): the k best of v (id, u) for each of q (query_id, uq) in each part of v.

    Up to ``few`` queries go to all tasks of v as one matrix; of more, tiles of queries meet tiles of v.
    """
    q, v = q.where("query_id is not null"), v.where("id is not null")
    qi, vi = q.schema["query_id"].dataType.simpleString(), v.schema["id"].dataType.simpleString()
    out = f"query_id {qi}, id {vi}, score double"
    head = q.limit(few + 1).toArrow()
    if head.num_rows <= few:
        ids, held = head["query_id"].combine_chunks(), matrix(head["uq"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from top(ids, held, batches, k)

        return v.select("id", "u").mapInArrow(scan, out)
    n, m = -(-q.count() // rows), -(-v.count() // rows)
    left = q.withColumn("p", F.pmod(F.xxhash64("query_id"), F.lit(n))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = v.withColumn("o", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": a["query_id"].slice(0, 0), "id": b["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        ids = a["query_id"].combine_chunks()
        return pa.Table.from_batches(list(top(ids, matrix(a["uq"]), iter(b.select(["id", "u"]).combine_chunks().to_batches()), k)))

    left, right = (dealt(x, ["p", "o"], n * m) for x in (left, right))
    return left.groupBy("p", "o").cogroup(right.groupBy("p", "o")).applyInArrow(meet, out)
