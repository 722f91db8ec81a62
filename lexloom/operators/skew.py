"""Joins in which no task gathers the rows of a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot that has over one in so many rows of a table, and over LEAST_HOT rows; so there are fewer hot keys than that.
HOT_SHARE, LEAST_HOT = 512, 256
#: Tables of so few rows are joined as they are.
FEW_ROWS = 4_000


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame | None = None, how: str = "inner", total: int | None = None, by: list[str] | None = None) -> DataFrame:
    """big joined with small on ``keys``, so that no task gathers all rows of a hot key.

    counts: (keys, rows), how many rows of big have a key, if that is known; keys that are left out are not hot. Rows of a hot
    key are dealt over as many pieces as keep each within the bound, and its rows of small are repeated for each piece. The
    pieces of all hot keys together are at most twice HOT_SHARE. big should be a written table, as it is counted first, unless
    its ``total`` rows are known. ``by`` are the columns that tell rows of a key apart (all of them by default).
    """
    total = big.count() if total is None else total
    if total <= FEW_ROWS:
        return big.join(small, keys, how)
    limit = max(LEAST_HOT, total // HOT_SHARE)
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    hot = counts.where(F.col("rows") > limit).select(F.xxhash64(*keys).alias("_lx_h"), F.ceil(F.col("rows") / limit).cast("int").alias("_lx_pieces")).groupBy("_lx_h").agg(F.max("_lx_pieces").alias("_lx_pieces")).collect()
    if not hot:
        return big.join(small, keys, how)
    table = F.broadcast(big.sparkSession.createDataFrame([tuple(r) for r in hot], "_lx_h long, _lx_pieces int"))  # fewer than HOT_SHARE rows
    pieces = F.coalesce("_lx_pieces", F.lit(1))
    left = big.withColumn("_lx_h", F.xxhash64(*keys)).join(table, "_lx_h", "left").withColumn("_lx_piece", F.pmod(F.xxhash64(*(by or big.columns)), pieces).cast("int")).drop("_lx_h", "_lx_pieces")
    right = small.withColumn("_lx_h", F.xxhash64(*keys)).join(table, "_lx_h", "left").withColumn("_lx_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_lx_h", "_lx_pieces")
    return left.join(right, [*keys, "_lx_piece"], how).drop("_lx_piece")
