"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive runs of bytes of their normalised text: first by length (where
a text ends) and its first bytes, then by longer and longer runs. A group that becomes single leaves;
a group whose texts have ended holds equal texts. No digest decides equality; the SHA-256 in the
result only reports, and rows are found again by their id and, where rows share an id, by place. Every split is one
aggregation, combined where rows are read, and one join in which the rows of a hot group are dealt over many
tasks; only documents that still have company go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, spread_join, written

#: Bytes of the first run; later runs are so many times longer, and at most LONGEST_RUN.
FIRST_BYTES = 64
GROWTH = 4
LONGEST_RUN = 1 << 20
RESERVED = 1 << 62
#: Up to so many ids of grouped documents are broadcast to fetch their texts, else joined.
BROADCAST_IDS = 200_000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` became one space; a null text is
    an empty one. Of equal texts the smallest doc_id stays. Rows that repeat a doc_id with an equal
    text each count in group_size and share ``kept``. A row without a doc_id stays only if no equal text
    has one; its keep_id is then null. Ids from 2**62 on are reserved. Columns other than doc_id
    and text are ignored; an empty table gives an empty result.
    """
    rows = _grouped(docs, broadcast_ids)
    return rows.select(
        F.col("own").alias("doc_id"),
        F.when(F.col("keep") < RESERVED, F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (F.col("keep") == F.col("id")).alias("kept"),
        "text_sha256",
    )


def _placed(df: DataFrame, text) -> DataFrame:
    """df with ``id`` and ``loc``, which finds a row again among those that share its id and tells two groups of such rows apart."""
    loc = F.xxhash64(text)
    return df.withColumns({"loc": loc, "id": F.coalesce("own", F.shiftrightunsigned(loc, 2).bitwiseOR(F.lit(RESERVED)))})


def _grouped(docs: DataFrame, broadcast_ids: int) -> DataFrame:
    """(own, id, loc, text_sha256, size, keep), a row a document; size is null for one that is alone."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("own"), normalised(F.col("text")).cast("binary").alias("t"))
    base = _placed(base, F.col("t")).withColumn("n", F.octet_length("t"))

    # one pass over the texts leaves what the first split and the result need of them
    firsts, _ = written(base.select("own", "id", "loc", "n", F.substring("t", 1, FIRST_BYTES).alias("run"), F.sha2("t", 256).alias("text_sha256")), "radix")
    split, held = _split(firsts.select("id", "loc", "n", "run"), ["n", "run"], FIRST_BYTES)
    groups = [_ended(split)]
    going, count = split.where("not ended").select("id", "loc", "n", "gid", "gloc"), split.where("not ended").count()
    at, step = FIRST_BYTES, FIRST_BYTES * GROWTH
    if count:
        wanted = going.distinct()
        b = base.withColumn("rest", F.expr(f"substring(t, {FIRST_BYTES + 1})")).drop("n")
        state, path = written(b.join(F.broadcast(wanted) if count <= broadcast_ids else wanted, ["id", "loc"]).select("id", "loc", "n", "gid", "gloc", "rest"), "radix")
        remove(spark, held)
        while True:
            keyed = state.withColumn("run", F.substring("rest", 1, step)).withColumnsRenamed({"gid": "g", "gloc": "gl"})
            split, held = _split(keyed, ["g", "gl", "n", "run"], at + step, F.expr(f"substring(rest, {step + 1})").alias("rest"))
            remove(spark, path)
            at, step = at + step, min(step * GROWTH, LONGEST_RUN)
            groups.append(_ended(split))
            state, path = split.where("not ended").drop("size", "ended"), held
            if state.isEmpty():
                break
    remove(spark, held)
    found = groups[0]
    for part in groups[1:]:
        found = found.unionByName(part)
    rows = firsts.select("own", "id", "loc", "text_sha256").join(found.distinct(), ["id", "loc"], "left")
    return rows.withColumn("keep", F.coalesce("gid", "id"))


def _split(keyed: DataFrame, keys: list[str], at: int, *more) -> tuple[DataFrame, str]:
    """Rows whose keys another row has too, with the least id and place of their group, its size, and whether their texts
    end within ``at`` bytes; written."""
    shared, path = written(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("gid"), F.min("loc").alias("gloc")).where("size > 1"), "groups")
    joined = spread_join(keyed, shared, keys, shared.select(*keys, F.col("size").alias("rows")))
    out = written(joined.select("id", "loc", "n", "gid", "gloc", "size", *more, (F.col("n") <= at).alias("ended")), "radix", partition_by="ended")
    remove(keyed.sparkSession, path)
    return out


def _ended(split: DataFrame) -> DataFrame:
    return written(split.where("ended").select("id", "loc", "gid", "size"), "ended")[0]


def drop_copies(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The documents that exact_dedup keeps, one row for each, with all their columns.

    Of equal texts the row with the smallest doc_id stays, a null text counting as an empty one; of rows that repeat
    an id and text one stays; a row without a doc_id stays when no equal text has one. An empty table gives an empty one.
    Only ids are grouped: texts are not shuffled while those to go are at most ``broadcast_ids``, and once beyond that.
    """
    rows, _ = written(_grouped(docs, broadcast_ids).select("id", "loc", (F.col("keep") == F.col("id")).alias("kept")), "kept")
    gone, _ = written(rows.where("not kept").select("id", "loc").distinct(), "gone")
    twins, _ = written(rows.where("kept").groupBy("id", "loc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id", "loc"), "twins")
    text = normalised(F.col("text")).cast("binary")
    loc = F.xxhash64(text)
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(loc, 2).bitwiseOR(F.lit(RESERVED)))

    def beside(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("id").alias("_lx_id"), F.col("loc").alias("_lx_loc"))
        ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
        return df.join(ids, (own == F.col("_lx_id")) & (loc == F.col("_lx_loc")), how)

    out = beside(docs, gone, "left_anti")
    if twins.isEmpty():
        return out
    again = beside(out, twins, "left_semi").withColumns({"_lx_own": own, "_lx_at": loc}).dropDuplicates(["_lx_own", "_lx_at"]).drop("_lx_own", "_lx_at")
    return beside(out, twins, "left_anti").unionByName(again)
