"""From identifiers to scored concepts. Every step is one aggregation on (subtoken, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_identifier, stop_words
from .graph import settled
from .skew import spread_join

#: As the analysis itself has them, and as the whole pipeline does.
MIN_FREQUENCY, LIBRARY_THRESHOLD, PIPELINE_THRESHOLD = 2, 0.1, 0.3


def subtokens(identifiers: DataFrame, languages: str = "") -> DataFrame:
    """Identifiers (name, entity_type, file, line, ...) by subtoken, without stop words: one row each."""
    out = identifiers.withColumn("subtoken", F.explode(split_identifier("name")))
    stops = sorted(stop_words(languages))
    return out.where(~F.col("subtoken").isin(stops)) if stops else out


def corpus(tokens: DataFrame) -> DataFrame:
    """(subtoken, file, n): how often each file uses a subtoken."""
    return tokens.groupBy("subtoken", "file").agg(F.count(F.lit(1)).alias("n"))


def file_count(identifiers: DataFrame) -> DataFrame:
    """One row: the number of files with an identifier, at least 1."""
    return identifiers.agg(F.greatest(F.countDistinct("file"), F.lit(1)).alias("files"))


def tfidf(counts: DataFrame, files: DataFrame) -> DataFrame:
    """(subtoken, total, df, score): the most uses in a file times ln(files / df); with one file, the uses alone."""
    by = counts.groupBy("subtoken").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"), F.max("n").alias("top"))
    # one row is joined to all
    joined = by.crossJoin(F.broadcast(files))
    return joined.select("subtoken", "total", "df", F.when(F.col("files") <= 1, F.col("top").cast("double")).otherwise(F.col("top") * F.log(F.col("files") / F.col("df"))).alias("score"))


def concepts(identifiers: DataFrame, languages: str = "", min_frequency: int = MIN_FREQUENCY, threshold: float = LIBRARY_THRESHOLD) -> DataFrame:
    """(canonical, total, df, score) of the subtokens used and scored enough."""
    scored = tfidf(corpus(subtokens(identifiers, languages)), file_count(identifiers))
    return scored.where((F.col("total") >= min_frequency) & (F.col("score") >= threshold)).withColumnRenamed("subtoken", "canonical")


def occurrences(tokens: DataFrame, kept: DataFrame) -> DataFrame:
    """(canonical, identifier, entity_type, file, line) of the concepts kept."""
    return tokens.join(kept.select(F.col("canonical").alias("subtoken")), "subtoken").select(F.col("subtoken").alias("canonical"), F.col("name").alias("identifier"), "entity_type", "file", "line")


def entity_types(tokens: DataFrame) -> DataFrame:
    """(subtoken, entity_types): the sorted distinct kinds of its identifiers."""
    return tokens.groupBy("subtoken").agg(F.array_sort(F.collect_set("entity_type")).alias("entity_types"))


def most_common_type(rows: DataFrame, key: str) -> DataFrame:
    """(key, entity_type): the mode; a tie goes to the first by name."""
    n = rows.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by("entity_type", F.struct(-F.col("n"), "entity_type")).alias("entity_type"))


def doc_context(kept: DataFrame, doc_texts: DataFrame, most: int = 5, broadcast_concepts: int = 100_000) -> DataFrame:
    """(canonical, doc_context): first lines of the first texts (file, line, text) that contain the concept.

    A concept counts as contained in any case and inside words. The vocabulary is the small side: it is
    broadcast while it has at most ``broadcast_concepts`` rows; beyond, texts are cut into the substrings of
    the vocabulary's lengths and joined.
    """
    words = kept.select("canonical").distinct()
    low = doc_texts.select("file", "line", F.lower("text").alias("low"), F.substring_index("text", "\n", 1).alias("head"))
    if kept.sparkSession.conf.get("spark.lexloom.theta", "auto") == "auto" and words.limit(broadcast_concepts + 1).count() <= broadcast_concepts:
        hits = low.join(F.broadcast(words), F.contains("low", F.col("canonical")))
    else:
        sizes = [r[0] for r in words.select(F.length("canonical").alias("n")).distinct().orderBy("n").collect()]
        grams = F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - n + 1, F.lit(1))), lambda i, n=n: F.substring(F.col("low"), i, n)) for n in sizes])))
        hits = low.withColumn("canonical", F.explode(grams)).join(words, "canonical")
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy("canonical").orderBy("file", "line", "head"))).where(F.col("rn") <= most)
    return ranked.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "head"))), lambda s: s["head"]).alias("doc_context"))


#: Concepts of a scope up to which its pairs are formed in its row; those of larger scopes are joined.
SCOPE_CONCEPTS = 300


def co_occurrence(tokens: DataFrame, kept: DataFrame, by_file: bool = False, in_row: int = SCOPE_CONCEPTS) -> DataFrame:
    """(a, b, weight), a < b: 1 for each identifier row that has both concepts, half for each scope that has both.

    Identifier rows pair their own distinct subtokens in the row, without a join. Scopes of the same name are one, whatever
    file they are in, unless ``by_file`` is on.
    """
    known = kept.select(F.col("canonical").alias("subtoken"))
    rows = tokens.select("name", "file", "line", "entity_type", "scope", "subtoken").join(known, "subtoken")
    per_name = rows.select("name", "subtoken").distinct().groupBy("name").agg(F.array_sort(F.collect_set("subtoken")).alias("t")).where(F.size("t") > 1)
    # a subtoken that a name repeats has as many rows for each use of the name
    times = F.size(F.filter(split_identifier("name"), lambda x: x == F.col("subtoken")))
    uses = rows.groupBy("name", "subtoken").agg((F.count(F.lit(1)) / F.first(times)).alias("c")).groupBy("name").agg(F.min("c").alias("uses"))
    pairs = lambda t: F.flatten(F.transform(t, lambda x: F.transform(F.filter(t, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    by_name = per_name.join(uses, "name").select(F.explode(pairs(F.col("t"))).alias("p"), F.col("uses").cast("double").alias("w")).select("p.a", "p.b", "w")
    scope = ["file", "scope"] if by_file else ["scope"]
    inside = settled(rows.where("scope is not null").select(*scope, "subtoken").distinct())
    sizes = settled(inside.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows")))
    few = inside.join(sizes.where((F.col("rows") > 1) & (F.col("rows") <= in_row)).drop("rows"), scope, "left_semi")
    by_scope = few.groupBy(*scope).agg(F.array_sort(F.collect_set("subtoken")).alias("t")).select(F.explode(pairs(F.col("t"))).alias("p"), F.lit(0.5).alias("w")).select("p.a", "p.b", "w")
    parts = [by_name, by_scope]
    large = settled(inside.join(sizes.where(F.col("rows") > in_row).drop("rows"), scope, "left_semi"))
    if not large.isEmpty():
        both = spread_join(large.withColumnRenamed("subtoken", "a"), large.withColumnRenamed("subtoken", "b"), scope, sizes)
        parts.append(both.where("a < b").select("a", "b", F.lit(0.5).alias("w")))
    return reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.sum("w").alias("weight"))
