"""The index store: relations as Parquet under a version folder, with a manifest of the files they come from.

A version is written whole and then named by a new, numbered pointer table; no pointer is ever overwritten, and a reader takes
the highest that is complete. So it sees the old or the new version, and a writer lost at any time leaves the old one. Relations that have a language are partitioned by it, so one language is read alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def manifest(files: DataFrame) -> DataFrame:
    """(file, modified) of files with modification times, to the second."""
    return files.select("file", F.date_trunc("second", "modified").alias("modified")).distinct()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change): files added, removed or modified between two manifests."""
    j = old.select("file", F.col("modified").alias("m0")).join(new.select("file", F.col("modified").alias("m1")), "file", "full")
    kind = F.when(F.col("m0").isNull(), "added").when(F.col("m1").isNull(), "removed").when(F.col("m0") != F.col("m1"), "modified")
    return j.select("file", kind.alias("change")).where("change is not null")


def is_fresh(old: DataFrame, new: DataFrame) -> bool:
    return changes(old, new).isEmpty()


def stale_languages(old: DataFrame, new: DataFrame) -> DataFrame:
    from .scan import language_of

    return changes(old, new).select(language_of(F.col("file")).alias("language")).where("language is not null").distinct()


def save(spark: SparkSession, path: str, relations: dict[str, DataFrame]) -> str:
    """Write a version of the relations and point to it; its name. A ``manifest`` (file, modified) among them is what load() checks."""
    version = uuid.uuid4().hex
    number = max(_pointers(spark, path), default=0) + 1
    for name, df in relations.items():
        w = df.write.mode("errorifexists")
        if "language" in df.columns:
            w = w.partitionBy("language")
        w.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version, FORMAT, ",".join(sorted(relations)))], "version string, format int, relations string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/pointers/{number:012d}")
    return version


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the pointers that were written to their end."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = lambda f: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return [int(f.getPath().getName()) for f in fs.listStatus(folder) if done(f)]


def load(spark: SparkSession, path: str, language: str | None = None, files: DataFrame | None = None, languages: set[str] | None = None) -> dict[str, DataFrame] | None:
    """The current version's relations; None where there is none or it has another format.

    With ``files`` (file, modified), None too where a file of the stored manifest is missing or was modified since, and with
    ``languages`` where the stored ones are others.
    """
    numbers = _pointers(spark, path)
    if not numbers:
        return None
    at = spark.read.parquet(f"{path}/pointers/{max(numbers):012d}").first()
    if at is None or at.format != FORMAT:
        return None
    names = at.relations.split(",")
    if files is not None or languages is not None:
        if "manifest" not in names:
            return None
        stored = spark.read.parquet(f"{path}/{at.version}/manifest").select("file", "modified")
        if files is not None and not changes(stored, manifest(files)).where("change <> 'added'").isEmpty():
            return None
        if languages is not None:
            from .scan import language_of

            if {r.language for r in stored.select(language_of(F.col("file")).alias("language")).where("language is not null").distinct().collect()} != languages:
                return None
    out = {name: spark.read.parquet(f"{path}/{at.version}/{name}") for name in names}
    return {k: v.where(F.col("language") == language) if language and "language" in v.columns else v for k, v in out.items()}


def upsert(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """A relation with the rows of changed files (file) replaced by the new ones."""
    return old.join(changed.select("file").distinct(), "file", "left_anti").unionByName(new.select(*old.columns))
