"""Queries over edges, vectors and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import concept_match
from ..functions.vectors import centroids
from ..operators import clusters as K
from ..operators import graph as G
from ..operators import vocabulary as V
from ..registry import query

R = 6


def vectors(spark, d):
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def partner_edges(spark, d, top: int = 3):
    """Each nation's most frequent suppliers' nations, by lineitems of its customers' orders."""
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = A.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    buyers = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = buyers.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    best = n.withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey"))).where(F.col("rn") <= top)
    return best.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").cast("long").alias("source"), F.col("s_nationkey").cast("long").alias("target"), "n")


PARTNERS = """
partners AS (
  SELECT c_nationkey::bigint AS source, s_nationkey::bigint AS target, n FROM (
    SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s_nationkey) AS rn FROM (
      SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL))
  WHERE rn <= 3 AND c_nationkey <> s_nationkey
)"""


@query("partner_graph", f"WITH {PARTNERS} SELECT * FROM partners")
def partner_graph(spark, d):
    return partner_edges(spark, d)


def all_words(spark, d):
    """The distinct words of documents."""
    return A.table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("canonical")).distinct()


@query("abbreviation_edges")
def abbreviation_edges(spark, d):
    """Of all distinct words; all pairs of them are too many for SQL, so tests hold this against brute force."""
    return G.abbreviation_edges(G.settled(all_words(spark, d)))


@query("find_abbreviation")
def find_abbreviation(spark, d):
    """The best expansion of all distinct words; likewise without SQL."""
    return G.best_expansion(G.settled(all_words(spark, d)))


@query(
    "concept_abbreviations",
    f"""WITH {A.VOCABULARY}, longer AS (SELECT canonical FROM concepts UNION SELECT canonical || 'ing' FROM concepts UNION SELECT canonical[1] || canonical[3:] FROM concepts WHERE length(canonical) > 3)
    SELECT a.canonical AS source, b.canonical AS target, 'AbbreviationOf' AS kind, 1.0::double AS weight FROM longer a JOIN longer b
    ON length(a.canonical) >= 3 AND length(a.canonical) < length(b.canonical) AND (starts_with(b.canonical, a.canonical) OR (a.canonical[1] = b.canonical[1] AND 3 * length(a.canonical) >= length(b.canonical)
      AND regexp_matches(b.canonical, '^' || array_to_string(list_transform(string_split(a.canonical, ''), lambda c: '[^' || c || ']*' || c), ''))))""",
)
def concept_abbreviations(spark, d):
    """The same edges over all concepts, their participles, and each without its second letter."""
    c = G.settled(V.concepts(A.identifiers(spark, d)).select("canonical"))
    shorter = c.where(F.length("canonical") > 3).select(F.concat(F.substring("canonical", 1, 1), F.substring("canonical", 3, 1000)).alias("canonical"))
    return G.abbreviation_edges(c.unionByName(c.select(F.concat("canonical", F.lit("ing")).alias("canonical"))).unionByName(shorter).distinct())


@query(
    "match_concept",
    f"""WITH {A.VOCABULARY}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM benchmark UNION SELECT canonical || 's' FROM concepts),
    p AS (SELECT w, canonical, CASE WHEN w = canonical THEN 0 WHEN strlen(w) >= 4 AND strlen(canonical) >= 4 AND (starts_with(w, canonical) OR starts_with(canonical, w)) THEN 1 END AS c FROM words, concepts)
    SELECT w AS subtoken, canonical FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY c, length(canonical) DESC, canonical) AS rn FROM p WHERE c IS NOT NULL) WHERE rn = 1""",
)
def match_concept(spark, d):
    """The concept of each word: equal, else the longest that begins it or that it begins."""
    concepts = G.settled(V.concepts(A.identifiers(spark, d)).select("canonical"))
    words = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("w"))
    words = words.unionByName(concepts.select(F.concat("canonical", F.lit("s")).alias("w"))).distinct()
    # a match shares the first letter, which the join is on
    p = words.join(concepts, F.substring("w", 1, 1) == F.substring("canonical", 1, 1)).withColumn("c", concept_match(F.col("w"), F.col("canonical"))).where("c is not null")
    return p.groupBy("w").agg(F.min_by("canonical", F.struct("c", -F.length("canonical"), "canonical")).alias("canonical")).withColumnRenamed("w", "subtoken")


@query(
    "contrastive_edges",
    f"""WITH {A.VOCABULARY}, known(a, b) AS (VALUES {', '.join(str(tuple(sorted(p))) for p in G.KNOWN_CONTRASTS)})
    SELECT a AS source, b AS target, 'Contrastive' AS kind, 1.0::double AS weight FROM known WHERE a IN (SELECT canonical FROM concepts) AND b IN (SELECT canonical FROM concepts)""",
)
def contrastive_edges(spark, d):
    ids = A.identifiers(spark, d)
    words = G.settled(V.concepts(ids).select("canonical"))
    return G.contrastive_edges(words, ids.select(F.concat_ws("|", "file", "scope").alias("list_id"), "name"), G.abbreviation_edges(words))


@query(
    "similar_edges",
    f"""SELECT a.vec_id AS source, b.vec_id AS target, 'SimilarTo' AS kind, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), {R}) AS weight
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id""",
)
def similar_edges(spark, d):
    return G.similar_edges(vectors(spark, d))[0].withColumn("weight", F.round("weight", R))


@query(
    "centroids",
    f"""SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, round(avg(x), {R}) AS m FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label""",
)
def centroid_query(spark, d):
    return centroids(vectors(spark, d), "label", "vector").withColumn("centroid", F.transform("centroid", lambda x: F.round(x, R)))


@query(
    "nearest_vectors",
    f"""SELECT query_id, id, rank, round(s, {R}) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS s,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::double[], v.embedding::double[]) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.vec_id % 100 = 0) WHERE rank <= 5""",
)
def nearest_vectors(spark, d):
    v = vectors(spark, d)
    return K.nearest(v.where(F.col("id") % 100 == 0), v, 5).withColumn("score", F.round("score", R))


@query(
    "nearest_centroid",
    f"""WITH flat AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM flat GROUP BY ALL) GROUP BY label),
    s AS (SELECT vec_id, c.label, round(list_cosine_similarity(embedding::double[], centroid), 9) AS s FROM embeddings, c)
    SELECT vec_id AS id, label, round(s, {R}) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM s) WHERE rn = 1""",
)
def nearest_centroid(spark, d):
    v = vectors(spark, d)
    return K.nearest_centroid(v, centroids(v, "label", "vector")).withColumn("score", F.round("score", R))


@query(
    "cross_reference",
    f"""WITH a AS (SELECT vec_id AS id, label AS a FROM embeddings), b AS (SELECT vec_id AS id, (vec_id % 7)::bigint AS b FROM embeddings)
    SELECT a, b, round(j, {R}) AS jaccard FROM (SELECT a.a, b.b, count(*) / (any_value(na) + any_value(nb) - count(*)) AS j FROM a JOIN b USING (id) JOIN (SELECT a AS x, count(*) AS na FROM a GROUP BY a) ON a.a = x JOIN (SELECT b AS y, count(*) AS nb FROM b GROUP BY b) ON b.b = y GROUP BY ALL) WHERE j >= 0.05""",
)
def cross_reference(spark, d):
    v = vectors(spark, d)
    return K.cross_reference(v.select("id", F.col("label").alias("a")), v.select("id", (F.col("id") % 7).alias("b")), 0.05).withColumn("jaccard", F.round("jaccard", R))


@query(
    "cluster_labels",
    """WITH m AS (SELECT user_id AS entity, (user_id % 5)::bigint AS label FROM events GROUP BY user_id), n AS (SELECT label, event_type, count(*) AS n FROM events JOIN m ON entity = user_id GROUP BY ALL)
    SELECT label, event_type AS behaviour FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, event_type) AS rn FROM n) WHERE rn = 1""",
)
def cluster_labels(spark, d):
    e = A.table(spark, d, "events")
    return K.cluster_labels(e.select(F.col("user_id").alias("entity"), (F.col("user_id") % 5).alias("label")).distinct(), e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("callee")))


@query("average_linkage")
def average_linkage(spark, d):
    return K.cluster(vectors(spark, d), 0.62)


_STEPS = 20


@query(
    "pagerank",
    f"""WITH RECURSIVE {PARTNERS}, nodes AS (SELECT n_nationkey::bigint AS id FROM nation), deg AS (SELECT source, count(*) AS o FROM partners GROUP BY source), indeg AS (SELECT target, count(*) AS i FROM partners GROUP BY target),
    {', '.join(f"r{i} AS (SELECT id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT source FROM deg)) / (SELECT count(*) FROM nodes)) AS r FROM nodes LEFT JOIN (SELECT target, sum(r / o) AS s FROM partners JOIN deg USING (source) JOIN r{i - 1} ON id = source GROUP BY target) ON id = target)" if i else "r0 AS (SELECT id, 1.0::double / (SELECT count(*) FROM nodes) AS r FROM nodes)" for i in range(_STEPS + 1))}
    SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, round(r, {R}) AS pagerank FROM r{_STEPS} LEFT JOIN deg ON source = id LEFT JOIN indeg ON target = id""",
)
def pagerank(spark, d):
    nodes = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return G.pagerank(nodes, partner_edges(spark, d), iterations=_STEPS, epsilon=None).withColumn("pagerank", F.round("pagerank", R))


@query(
    "reachability",
    f"""WITH RECURSIVE {PARTNERS}, walk(id, depth) AS (SELECT 0::bigint, 0 UNION SELECT target, depth + 1 FROM walk JOIN partners ON source = id WHERE depth < 4) SELECT id, min(depth) AS depth FROM walk GROUP BY id""",
)
def reachability(spark, d):
    seeds = A.table(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").cast("long").alias("id"))
    return G.reach(seeds, partner_edges(spark, d), 4)


@query("topological_order")
def topological_order(spark, d):
    """The partner graph of the 25 nations in order, each with its place."""
    edges = partner_edges(spark, d).select("source", "target").collect()  # at most 75 rows
    nodes = [r[0] for r in A.table(spark, d, "nation").select("n_nationkey").collect()]
    order = G.topological_order(nodes, [(r.source, r.target) for r in edges])
    return spark.createDataFrame([(n, i) for i, n in enumerate(order)], "id long, place long")


@query(
    "diverse_entities",
    """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'method' ELSE 'function' END AS kind, p_retailprice AS density, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS label FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY kind = 'method', density DESC, id) AS turn, CASE WHEN label IS NOT NULL THEN count(*) OVER (PARTITION BY label) ELSE 0 END AS size FROM e)
    SELECT id, label, turn FROM r ORDER BY turn, label IS NULL, size DESC, label LIMIT 60""",
)
def diverse_entities(spark, d):
    part = A.table(spark, d, "part")
    e = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "method").otherwise("function").alias("kind"), F.col("p_retailprice").alias("density"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("label"))
    return K.diverse(e, 60).select("id", "label", "turn")


@query("subconcepts")
def subconcepts(spark, d):
    ids = A.identifiers(spark, d)
    occ = V.occurrences(V.subtokens(ids), V.concepts(ids))
    params = ids.select(F.col("name").alias("identifier"), F.lower("entity_type").alias("t")).distinct()
    return G.subconcepts(occ, params)


