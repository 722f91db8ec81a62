"""Queries over the vocabulary: subtokens, scores, conventions, co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as T
from ..operators import conventions as C
from ..operators import vocabulary as V
from ..operators.graph import settled, small
from ..registry import query

R = 6


@query("split_identifier", f"WITH {A.IDS}, camel AS (SELECT * FROM ids) SELECT name, {A.split_sql('name')} AS tokens, count(*) AS n FROM ids GROUP BY 1, 2")
def split_identifier(spark, d):
    return A.identifiers(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", T.split_identifier("name").alias("tokens"), "n")


@query("split_camel", f"WITH {A.CAMEL} SELECT DISTINCT name, {A.split_sql('name')} AS tokens FROM ids")
def split_camel(spark, d):
    return A.camel_identifiers(spark, d).select("name").distinct().select("name", T.split_identifier("name").alias("tokens"))


@query("stop_words", f"WITH {A.IDS}, {A.TOKENS} SELECT t AS subtoken, count(*) AS n FROM tok WHERE t NOT IN ({', '.join(repr(w) for w in sorted(T.stop_words('python,rust')))}) GROUP BY t")
def stop_words(spark, d):
    return V.subtokens(A.identifiers(spark, d), "python,rust").groupBy("subtoken").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_counts", f"WITH {A.IDS}, {A.TOKENS} SELECT t AS subtoken, file, count(*) AS n FROM tok GROUP BY ALL")
def corpus_counts(spark, d):
    return V.corpus(V.subtokens(A.identifiers(spark, d)))


@query("tfidf", f"WITH {A.VOCABULARY} SELECT t AS subtoken, total, df, round(score, {R}) AS score FROM scored")
def tfidf(spark, d):
    ids = A.identifiers(spark, d)
    return V.tfidf(V.corpus(V.subtokens(ids)), V.file_count(ids)).withColumn("score", F.round("score", R))


@query(
    "list_concepts",
    f"""WITH {A.VOCABULARY}, types AS (SELECT t, list_sort(list(DISTINCT entity_type)) AS entity_types, count(DISTINCT name) AS identifiers FROM tok GROUP BY t)
    SELECT canonical, total AS occurrences, round(score, {R}) AS score, entity_types, identifiers FROM concepts JOIN types ON canonical = t ORDER BY total DESC, canonical LIMIT 200""",
)
def list_concepts(spark, d, top_k: int = 200):
    """The most used concepts; at most 350 whatever is asked for."""
    ids = A.identifiers(spark, d)
    tokens = V.subtokens(ids)
    more = tokens.groupBy("subtoken").agg(F.array_sort(F.collect_set("entity_type")).alias("entity_types"), F.countDistinct("name").alias("identifiers"))
    kept = V.concepts(ids).join(more, F.col("canonical") == F.col("subtoken"))
    return kept.select("canonical", F.col("total").alias("occurrences"), F.round("score", R).alias("score"), "entity_types", "identifiers").orderBy(F.desc("occurrences"), "canonical").limit(min(top_k, 350))


@query(
    "document_tfidf",
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS t FROM documents), c AS (SELECT t, doc_id, count(*) AS n FROM w GROUP BY ALL)
    SELECT t AS subtoken, sum(n)::bigint AS total, count(*) AS df, round(max(n) * ln((SELECT count(*) FROM (SELECT DISTINCT doc_id FROM w)) / count(*)), {R}) AS score FROM c GROUP BY t HAVING sum(n) >= 2""",
)
def document_tfidf(spark, d):
    docs = A.table(spark, d, "documents")
    words = docs.select(F.col("doc_id").alias("file"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("subtoken"))
    counts = V.corpus(words)
    files = counts.agg(F.countDistinct("file").alias("files"))
    return V.tfidf(counts, files).where("total >= 2").withColumn("score", F.round("score", R))


@query(
    "entity_type_mode",
    f"WITH {A.IDS}, {A.TOKENS}, c AS (SELECT t, entity_type, count(*) AS n FROM tok GROUP BY ALL) SELECT t AS subtoken, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, entity_type) AS rn FROM c) WHERE rn = 1",
)
def entity_type_mode(spark, d):
    return V.most_common_type(V.subtokens(A.identifiers(spark, d)), "subtoken")


@query(
    "doc_context",
    f"""WITH {A.VOCABULARY}, doc AS (SELECT doc_id AS file, 1 AS line, lower(text) AS low, string_split(text, chr(10))[1] AS head FROM documents),
    hit AS (SELECT canonical, head, row_number() OVER (PARTITION BY canonical ORDER BY file, line, head) AS rn FROM concepts JOIN doc ON contains(low, canonical))
    SELECT canonical, list(head ORDER BY rn) AS doc_context FROM hit WHERE rn <= 5 GROUP BY canonical""",
)
def doc_context(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.lit(1).alias("line"), "text")
    return V.doc_context(V.concepts(A.identifiers(spark, d)), docs)


_CONVENTIONS = r"""
shaped AS (
  SELECT name, entity_type, unnest([
    {'shape': 'prefix', 'kind': 'Prefix', 'value': nullif(regexp_extract(name, '^([a-z]{1,4})_', 1), '') || '_', 'least': 3},
    {'shape': 'suffix', 'kind': 'Suffix', 'value': '_' || nullif(regexp_extract(name, '^.+_([a-z]{1,6})$', 1), ''), 'least': 3},
    {'shape': 'conversion', 'kind': 'Conversion', 'value': CASE WHEN len(string_split(name, '_to_')) = 2 AND string_split(name, '_to_')[1] <> '' AND string_split(name, '_to_')[2] <> '' THEN '_to_' END, 'least': 3},
    {'shape': 'camel', 'kind': 'Prefix', 'value': nullif(regexp_extract(name, '^([a-z]{2,6})\p{Lu}', 1), ''), 'least': 5},
    {'shape': 'observable', 'kind': 'Suffix', 'value': CASE WHEN ends_with(name, '$') AND length(name) > 1 THEN '$' END, 'least': 3},
    {'shape': 'interface', 'kind': 'Prefix', 'value': CASE WHEN regexp_matches(name, '^I\p{Lu}') THEN 'I' END, 'least': 3}]) AS p
  FROM ids
), fit AS (SELECT name, entity_type, p.shape AS shape, p.kind AS kind, p.value AS value, p.least AS least FROM shaped WHERE p.value IS NOT NULL
), modes AS (
  SELECT shape, value, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY shape, value ORDER BY n DESC, entity_type) AS rn
    FROM (SELECT shape, value, entity_type, count(*) AS n FROM fit GROUP BY shape, value, entity_type)) WHERE rn = 1
), conventions AS (
  SELECT kind, value, m.entity_type, CASE WHEN shape = 'conversion' THEN 'conversion' WHEN shape = 'observable' THEN 'Observable' WHEN shape = 'interface' THEN 'interface'
    ELSE coalesce(map {ROLES}[shape || value], replace(shape, 'camel', 'prefix') || ' pattern') END AS semantic_role,
    examples, frequency
  FROM (SELECT shape, kind, value, any_value(least) AS least, list_sort(list(name)) AS examples, CASE WHEN shape = 'conversion' THEN count(*) ELSE count(DISTINCT name) END AS frequency FROM fit GROUP BY shape, kind, value)
  JOIN modes m USING (shape, value) WHERE frequency >= least
)""".replace("{ROLES}", "{" + ", ".join(f"'{s}{k}': '{v}'" for s, t in (("prefix", T.PREFIX_ROLES), ("suffix", T.SUFFIX_ROLES), ("camel", T.CAMEL_ROLES)) for k, v in t.items()) + "}")


@query("list_conventions", f"WITH {A.IDS}, {_CONVENTIONS} SELECT * FROM conventions")
def list_conventions(spark, d):
    return C.conventions(A.identifiers(spark, d))


@query("camel_conventions", f"WITH {A.CAMEL}, {_CONVENTIONS} SELECT * FROM conventions")
def camel_conventions(spark, d):
    return C.conventions(A.camel_identifiers(spark, d))


@query(
    "merge_conventions",
    f"""WITH {A.IDS}, {_CONVENTIONS} SELECT kind, value, semantic_role, frequency FROM conventions
    UNION ALL SELECT * FROM (VALUES ('Prefix', 'calc_', 'computation', 0)) v(kind, value, semantic_role, frequency)""",
)
def merge_conventions(spark, d):
    added = spark.createDataFrame([("Prefix", "calc_", "Function", "computation"), ("Prefix", "old_", "Function", "ignored: known")], "kind string, value string, entity_type string, semantic_role string")
    return C.merge_conventions(C.conventions(A.identifiers(spark, d)), added).select("kind", "value", "semantic_role", "frequency")


_CO = """
pairs AS (
  SELECT a.t AS a, b.t AS b, 1.0::double AS w FROM (SELECT DISTINCT name, file, line, t FROM tok) a JOIN (SELECT DISTINCT name, file, line, t FROM tok) b ON a.name = b.name AND a.file = b.file AND a.line = b.line AND a.t < b.t
  UNION ALL SELECT a.t, b.t, 0.5 FROM (SELECT DISTINCT scope, t FROM tok) a JOIN (SELECT DISTINCT scope, t FROM tok) b ON a.scope = b.scope AND a.t < b.t
), co AS (SELECT a, b, sum(w) AS weight FROM pairs WHERE a IN (SELECT canonical FROM concepts) AND b IN (SELECT canonical FROM concepts) GROUP BY ALL)"""


@query("co_occurrence", f"WITH {A.VOCABULARY}, {_CO} SELECT * FROM co")
def co_occurrence(spark, d):
    ids = A.identifiers(spark, d)
    return V.co_occurrence(V.subtokens(ids), V.concepts(ids))


@query(
    "convention_coverage",
    f"""WITH {A.IDS}, {_CONVENTIONS}, n AS (SELECT name, count(*) AS uses FROM ids GROUP BY name)
    SELECT name, uses, (SELECT count(*) FROM conventions c WHERE CASE c.kind WHEN 'Prefix' THEN starts_with(lower(name), c.value) WHEN 'Suffix' THEN ends_with(lower(name), c.value) ELSE contains(lower(name), c.value) END) AS n_conventions FROM n""",
)
def convention_coverage(spark, d):
    ids = A.identifiers(spark, d)
    names = ids.groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    found = settled(C.conventions(ids).select("kind", "value"))
    hit = names.join(small(found), C.matches(F.col("name"), F.col("kind"), F.col("value")), "left")
    return hit.groupBy("name", "uses").agg(F.count("kind").alias("n_conventions"))


@query(
    "naming_roles",
    f"""WITH {A.CAMEL} SELECT DISTINCT name, coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in T.CAMEL_ROLES.items())}}}[regexp_extract(name, '^([a-z]{{2,6}})\\p{{Lu}}', 1)], 'prefix pattern') AS role FROM ids""",
)
def naming_roles(spark, d):
    return A.camel_identifiers(spark, d).select("name").distinct().select("name", T.camel_prefix_role(F.regexp_extract("name", r"^([a-z]{2,6})\p{Lu}", 1)).alias("role"))
