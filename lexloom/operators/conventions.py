"""Naming conventions mined from identifiers: one pass over the names with each pattern as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import camel_prefix_role, prefix_role, suffix_role
from .vocabulary import most_common_type

THRESHOLD, CAMEL_LEAST = 3, 5
COLUMNS = ["kind", "value", "entity_type", "semantic_role", "examples", "frequency"]


def patterns(name: Column) -> dict[str, Column]:
    """What each convention would read out of a name; null where it does not fit."""
    got = lambda rx: F.when(F.regexp_extract(name, rx, 1) != "", F.regexp_extract(name, rx, 1))
    parts = F.split(name, "_to_")
    return {
        "prefix": F.concat(got(r"^([a-z]{1,4})_"), F.lit("_")),
        "suffix": F.concat(F.lit("_"), got(r"^.+_([a-z]{1,6})$")),
        "conversion": F.when((F.size(parts) == 2) & (F.get(parts, 0) != "") & (F.get(parts, 1) != ""), F.lit("_to_")),
        "camel": got(r"^([a-z]{2,6})\p{Lu}"),
        "observable": F.when(F.endswith(name, F.lit("$")) & (F.length(name) > 1), F.lit("$")),
        "interface": F.when(F.regexp_like(name, F.lit(r"^I\p{Lu}")), F.lit("I")),
    }


def conventions(identifiers: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(kind, value, entity_type, semantic_role, examples, frequency).

    frequency counts distinct names, for conversions their uses; examples are all uses, sorted. A camel-case
    prefix needs ``max(threshold, 5)`` names.
    """
    found = patterns(F.col("name"))
    tagged = identifiers.select("name", "entity_type", F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), v.alias("value")) for k, v in found.items()])).alias("p")).where("p.value is not null")
    tagged = tagged.select("name", "entity_type", "p.shape", "p.value", F.concat_ws("|", "p.shape", "p.value").alias("key"))
    grouped = tagged.groupBy("key", "shape", "value").agg(F.countDistinct("name").alias("distinct"), F.count(F.lit(1)).alias("uses"), F.array_sort(F.collect_list("name")).alias("examples"))
    frequency = F.when(F.col("shape") == "conversion", F.col("uses")).otherwise(F.col("distinct"))
    least = F.when(F.col("shape") == "camel", F.lit(max(threshold, CAMEL_LEAST))).otherwise(F.lit(threshold))
    kept = grouped.withColumn("frequency", frequency).where(F.col("frequency") >= least)
    role = (
        F.when(F.col("shape") == "prefix", prefix_role(F.col("value")))
        .when(F.col("shape") == "suffix", suffix_role(F.col("value")))
        .when(F.col("shape") == "camel", camel_prefix_role(F.col("value")))
        .when(F.col("shape") == "conversion", F.lit("conversion"))
        .when(F.col("shape") == "observable", F.lit("Observable"))
        .otherwise(F.lit("interface"))
    )
    kind = F.when(F.col("shape").isin("suffix", "observable"), "Suffix").when(F.col("shape") == "conversion", "Conversion").otherwise("Prefix")
    mode = most_common_type(tagged, "key")
    return kept.join(mode, "key").select(kind.alias("kind"), "value", "entity_type", role.alias("semantic_role"), "examples", "frequency")


def matches(identifier: Column, kind: Column, value: Column) -> Column:
    """Whether an identifier, lower-cased, follows a convention."""
    low = F.lower(identifier)
    return F.when(kind == "Prefix", F.startswith(low, value)).when(kind == "Suffix", F.endswith(low, value)).otherwise(F.contains(low, value))


def merge_conventions(found: DataFrame, configured: DataFrame) -> DataFrame:
    """Add configured conventions (kind, value, entity_type, semantic_role) whose pattern is new, with frequency 0."""
    new = configured.join(found.select("kind", "value"), ["kind", "value"], "left_anti")
    return found.select(*COLUMNS).unionByName(new.select("kind", "value", "entity_type", "semantic_role", F.array().cast("array<string>").alias("examples"), F.lit(0).cast("long").alias("frequency")))
