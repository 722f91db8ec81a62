"""The change feed: new versions of files as a stream; each micro-batch replaces the changed files' relations.

The source is a directory of change records or of source files; the query's checkpoint remembers what was read, so a
restart neither loses nor repeats a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RELATIONS
from ..sources import store
from ..sources.frontends import parse, relation
from ..sources.scan import language_of


def changed_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """(file, language, content, modified) of files as they appear under ``root``."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)
    out = raw.select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified")).withColumn("language", language_of(F.col("file")))
    return out.where("language is not null").select("file", "language", "content", "modified")


def latest(batch: DataFrame) -> DataFrame:
    """One row a file: its last version."""
    return batch.groupBy("file").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "file"]), "modified").alias("v")).select("file", "v.*")


def present_files(spark: SparkSession, root: str) -> DataFrame:
    """(file) of the files there are now under ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"))


def apply_batch(spark: SparkSession, path: str, batch: DataFrame, present: DataFrame | None = None) -> None:
    """Parse the files of a micro-batch and write the next version of the index. With ``present`` (file), rows of files
    that are gone go too; the new version is written whole."""
    new = parse(latest(batch).select("file", "language", "content")).persist()
    try:
        fresh = {k: relation(new, k) for k in RELATIONS}
        old = store.load(spark, path)
        changed = new.select("file")
        now = fresh if old is None else {k: store.upsert(old[k], v, changed) for k, v in fresh.items()}
        if present is not None:
            here = present.select("file").distinct()
            now = {k: v.join(here, "file", "left_semi").select(*v.columns) for k, v in now.items()}
        store.save(spark, path, now)
    finally:
        new.unpersist()


def watch(spark: SparkSession, root: str, index: str, checkpoint: str, then: Callable[[dict[str, DataFrame]], None] | None = None, interval: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Keep an index of ``root`` up to date; ``then`` is called with the relations after each batch.

    A stream of files tells nothing of deleted ones, so each batch also drops the rows of files that are gone by then.
    """
    source, target = root.rstrip("/"), index.rstrip("/")
    if (target + "/").startswith(source + "/"):
        raise ValueError("the index must lie outside what is watched")

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        apply_batch(batch.sparkSession, index, batch, present_files(batch.sparkSession, root))
        if then is not None:
            then(store.load(batch.sparkSession, index))

    writer = changed_files(spark, root).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def enrich(spark: SparkSession, texts: DataFrame, done_path: str, batch: int = 64, wanted: Callable[[], bool] = lambda: True) -> DataFrame:
    """Embed texts (id, text) that are not embedded yet, in batches that are each kept, until done or no longer wanted."""
    from ..operators import embedding

    ident = texts.schema["id"].dataType.simpleString()
    while wanted():
        try:
            done = spark.read.parquet(done_path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], f"id {ident}, vector array<double>")
        part = embedding.plan(texts, done).orderBy("id").limit(batch)
        if part.isEmpty():
            return done
        embedding.embed(part).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)
