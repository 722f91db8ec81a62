"""The generic relations, projected from star-schema tables, in DataFrames and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two identifiers a part: its name in snake case, and the same after its type."""
    part = table(spark, sf_dir, "part")
    snake = F.replace("p_name", F.lit(" "), F.lit("_"))
    base = part.select(
        F.explode(F.array(snake, F.concat_ws("_", F.lower("p_type"), snake))).alias("name"),
        F.col("p_type").alias("entity_type"),
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("file"),
        F.col("p_partkey").alias("line"),
        F.concat_ws(".", "p_brand", "p_type").alias("scope"),
    )
    return base


def camel_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names in camel case, as interfaces for MEDIUM and as observables for PROMO parts."""
    part = table(spark, sf_dir, "part")
    pascal = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 100))
    name = F.when(F.col("p_type") == "MEDIUM", F.concat(F.lit("I"), pascal)).when(F.col("p_type") == "PROMO", F.concat(camel, F.lit("$"))).otherwise(camel)
    return part.select(name.alias("name"), F.col("p_type").alias("entity_type"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("file"), F.col("p_partkey").alias("line"), F.col("p_brand").alias("scope"))


IDS = """
ids AS (
  SELECT unnest([replace(p_name, ' ', '_'), lower(p_type) || '_' || replace(p_name, ' ', '_')]) AS name, p_type AS entity_type,
         p_brand || '/' || p_size AS file, p_partkey AS line, p_brand || '.' || p_type AS scope FROM part
)"""

CAMEL = """
ids AS (
  SELECT CASE p_type WHEN 'MEDIUM' THEN 'I' || pascal WHEN 'PROMO' THEN lower(pascal[1]) || pascal[2:] || '$' ELSE lower(pascal[1]) || pascal[2:] END AS name,
         p_type AS entity_type, p_brand || '/' || p_size AS file, p_partkey AS line, p_brand AS scope
  FROM (SELECT *, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS pascal FROM part)
)"""


def split_sql(name: str) -> str:
    return rf"list_filter(string_split(lower(regexp_replace(regexp_replace({name}, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1_\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g')), '_'), lambda x: x <> '')"


TOKENS = f"tok AS (SELECT *, unnest({split_sql('name')}) AS t FROM ids)"
SCORES = """
counts AS (SELECT t, file, count(*) AS n FROM tok GROUP BY ALL),
scored AS (SELECT t, sum(n)::bigint AS total, count(*) AS df, max(n) * ln((SELECT greatest(count(DISTINCT file), 1) FROM ids) / count(*)) AS score FROM counts GROUP BY t),
concepts AS (SELECT t AS canonical, total, df, score FROM scored WHERE total >= 2 AND score >= 0.1)"""
VOCABULARY = f"{IDS}, {TOKENS}, {SCORES}"
