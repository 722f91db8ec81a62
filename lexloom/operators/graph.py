"""Edges between concepts and entities, ranking and reachability. Edges are rows (source, target, kind, weight)."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import KNOWN_CONTRASTS
from ..functions.text import split_identifier
from ..functions.vectors import centroids, dot, unit
from . import abbreviations
from .skew import HOT_SHARE, LEAST_HOT, spread_join
from .tiles import cluster_pairs

DAMPING, ITERATIONS, EPSILON = 0.85, 50, 1e-6
#: Rows of a table that is broadcast, at most; larger ones are shuffled.
SMALL = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lexloom.local.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.lexloom.local.dir", base)
    return base.rstrip("/")


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows, which is looked up; else as it is, whole."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read again, so that an iteration's lineage stays short."""
    path = f"{checkpoint_dir(df.sparkSession)}/lexloom-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexloom-step-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Links:
    """Weighted edges (source, target, share) along which values flow, many times over.

    Few edges (SMALL at most) are broadcast. More are bucketed and sorted once by source, the edges of a hub by source and
    piece; then a round shuffles the values and the sums, and never the edges.
    """

    def __init__(self, edges: DataFrame, small_rows: int = SMALL, bucket_rows: int = 1_000_000):
        edges = settled(edges.select("source", "target", "share"))
        count = edges.count()
        self.spark, self.few, self.name, self.hot = edges.sparkSession, count <= small_rows, None, None
        if self.few:
            self.edges = edges
            return
        limit = max(LEAST_HOT, count // HOT_SHARE)
        hubs = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("source", F.ceil(F.col("n") / limit).cast("int").alias("pieces")).collect()
        self.hot = F.broadcast(self.spark.createDataFrame([tuple(r) for r in hubs], f"source {edges.schema['source'].dataType.simpleString()}, pieces int"))  # fewer than HOT_SHARE rows
        dealt = edges.join(self.hot, "source", "left").withColumn("piece", F.pmod(F.xxhash64("target"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
        self.buckets = min(32_768, 1 + count // bucket_rows)
        self.name, self.path = f"lexloom_links_{uuid.uuid4().hex}", f"{checkpoint_dir(self.spark)}/lexloom-links-{uuid.uuid4().hex}"
        dealt.repartition(self.buckets, "source", "piece").write.option("path", self.path).bucketBy(self.buckets, "source", "piece").sortBy("source", "piece").saveAsTable(self.name)
        self.edges = self.spark.table(self.name)
        dropped(edges)

    def flow(self, values: DataFrame) -> DataFrame:
        """(id, value): what the targets get, each edge carrying its share of its source's value (id, value)."""
        if self.few:
            sent = values.select(F.col("id").alias("source"), "value").join(F.broadcast(self.edges), "source")
        else:
            dealt = values.select(F.col("id").alias("source"), "value").join(self.hot, "source", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
            sent = self.edges.join(dealt.select("source", "piece", "value").hint("merge"), ["source", "piece"])
        return sent.groupBy(F.col("target").alias("id")).agg(F.sum(F.col("value") * F.col("share")).alias("value"))

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def abbreviation_pairs(words: DataFrame, shortest: int = 1, best: bool = False) -> DataFrame:
    """(short, long, class) for distinct words (canonical) of which one abbreviates another, as abbreviation_class() has it; with
    ``best`` only what may be the best expansion."""
    return abbreviations.pairs(words, shortest, best)


def abbreviation_edges(words: DataFrame, shortest: int = 3) -> DataFrame:
    """(source short, target long, kind, weight) for words (canonical) that abbreviate another."""
    return abbreviation_pairs(words, shortest).select(F.col("short").alias("source"), F.col("long").alias("target"), F.lit("AbbreviationOf").alias("kind"), F.lit(1.0).alias("weight"))


def best_expansion(words: DataFrame) -> DataFrame:
    """(short, expansion, class) of each word (canonical) that abbreviates another: the best class, then the shortest, then the first by name."""
    best = abbreviation_pairs(words, best=True).groupBy("short").agg(F.min(F.struct("class", F.length("long").alias("n"), "long")).alias("m"))
    return best.select("short", F.col("m.long").alias("expansion"), F.col("m.class").alias("class"))


def contrastive_edges(words: DataFrame, parameter_lists: DataFrame, short: DataFrame, together: int = 3) -> DataFrame:
    """Contrastive pairs (source < target) of words.

    Score 3 for a known pair, 2 more for a pair found in ``together`` parameter lists (list_id, name) or
    more; 3 is needed. Pairs joined by an abbreviation (short) are left out.
    """
    spark = words.sparkSession
    known = spark.createDataFrame([tuple(sorted(p)) for p in KNOWN_CONTRASTS], "source string, target string")
    tokens = parameter_lists.select("list_id", F.explode(F.array_distinct(split_identifier("name"))).alias("t")).distinct()
    tokens = tokens.join(words.select(F.col("canonical").alias("t")), "t", "left_semi")
    lists = tokens.groupBy("list_id").agg(F.array_sort(F.collect_set("t")).alias("ts")).where(F.size("ts") > 1)
    pairs = F.flatten(F.transform("ts", lambda x: F.transform(F.filter("ts", lambda y: y > x), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    counted = lists.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= together)
    scored = known.withColumn("s", F.lit(3)).unionByName(counted.select("source", "target", F.lit(2).alias("s"))).groupBy("source", "target").agg(F.sum("s").alias("s")).where("s >= 3")
    here = words.select(F.col("canonical").alias("w"))
    scored = scored.join(here, F.col("source") == F.col("w"), "left_semi").join(here, F.col("target") == F.col("w"), "left_semi")
    joined = short.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return scored.join(joined, ["source", "target"], "left_anti").select("source", "target", F.lit("Contrastive").alias("kind"), F.lit(1.0).alias("weight"))


def similar_edges(vectors: DataFrame, ident: str = "id", label: str = "label", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """SimilarTo edges of all pairs within a cluster with their cosine, and the clusters' centroids.

    Vectors are scaled to length 1 first, so that a pair costs one product; a large cluster's rows meet as matrices, tile by tile.
    """
    u = vectors.where(F.col(label).isNotNull()).select(F.col(ident).alias("id"), F.col(label).alias("label"), unit(F.col(vector)).alias("u"))
    edges = cluster_pairs(u).select("source", "target", F.lit("SimilarTo").alias("kind"), "weight")
    return edges, centroids(vectors, label, vector)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, epsilon: float | None = EPSILON, every: int = 3) -> DataFrame:
    """(id, in_degree, out_degree, pagerank) over nodes (id) and edges (source, target); several edges count several times.

    Rank of nodes without a way out is spread evenly. Ends after ``iterations`` or, with ``epsilon``, when no rank
    moves by as much (asked every ``every`` rounds, when lineage is cut too). A round shuffles ranks and sums; many edges
    stay in buckets by source, few are broadcast.
    """
    nodes = settled(nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"), F.lit(0.0).alias("pagerank"))
    counted = settled(edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("c")))
    known = lambda df, end: spread_join(df, nodes.withColumnRenamed("id", end), [end], how="left_semi")
    live = settled(known(settled(known(counted, "source")), "target"))
    out = settled(live.groupBy("source").agg(F.sum("c").alias("out_degree"), F.count(F.lit(1)).alias("rows")))
    into = live.groupBy("target").agg(F.sum("c").alias("in_degree"))
    base = settled(nodes.join(out.select(F.col("source").alias("id"), "out_degree"), "id", "left").join(into.withColumnRenamed("target", "id"), "id", "left").na.fill(0, ["in_degree", "out_degree"]))
    links = Links(spread_join(live, out.select("source", "out_degree"), ["source"], out.select("source", "rows")).select("source", "target", (F.col("c") / F.col("out_degree")).alias("share")))
    rank, held = base.select("id", "out_degree", F.lit(1.0 / n).alias("value")), None
    for i in range(1, iterations + 1):
        lost = rank.where("out_degree = 0").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("lost"))
        new = base.select("id", "out_degree").join(links.flow(rank).withColumnRenamed("value", "s"), "id", "left").crossJoin(F.broadcast(lost))  # one row
        value = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("s", F.lit(0.0)) + F.col("lost") / n)
        old, rank = rank, new.select("id", "out_degree", value.alias("value"))
        if i % every == 0 or i == iterations:
            rank = settled(rank)
            if epsilon is not None and i < iterations:
                moved = rank.alias("x").join(old.alias("y"), "id").agg(F.max(F.abs(F.col("x.value") - F.col("y.value")))).first()[0]
                if moved is not None and moved < epsilon:
                    break
            if held is not None:
                dropped(held)
            held = rank
    links.drop()
    return base.join(rank.select("id", "value"), "id").select("id", "in_degree", "out_degree", F.col("value").alias("pagerank"))


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth): nodes within ``max_depth`` steps of the seeds (id). Each round joins the new frontier only."""
    seen = settled(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    steps = edges.select("source", "target").distinct()
    for depth in range(1, max_depth + 1):
        new = steps.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = settled(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def topological_order(nodes: list, edges: list[tuple]) -> list:
    """Of a small collected subgraph: a topological order, ties by name; nodes of cycles follow breadth-first, then the rest."""
    nodes = sorted(set(nodes))
    after: dict = {n: set() for n in nodes}
    missing = dict.fromkeys(nodes, 0)
    for a, b in set(edges):
        if a in after and b in after and a != b and b not in after[a]:
            after[a].add(b)
            missing[b] += 1
    ready, out = [n for n in nodes if not missing[n]], []
    roots = list(ready)
    while ready:
        n = ready.pop(0)
        out.append(n)
        for m in sorted(after[n]):
            missing[m] -= 1
            if not missing[m]:
                ready.append(m)
        ready.sort()
    if len(out) == len(nodes):
        return out
    out, queue = [], roots
    while queue:
        n = queue.pop(0)
        if n not in out:
            out.append(n)
            queue.extend(sorted(after[n]))
    return out + [n for n in nodes if n not in out]


def label_propagation(edges: DataFrame, group: str) -> DataFrame:
    """(group, node, component) of undirected edges (group, a, b) within groups: the least node reachable.

    A round takes the least label of a node's neighbours and then that label's own label, so long chains take few rounds.
    """
    both = settled(edges.select(group, F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(group, F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = both.select(group, F.col("x").alias("node"), F.col("x").alias("component")).distinct()
    while True:
        near = both.join(label.withColumnRenamed("node", "y"), [group, "y"]).groupBy(group, "x").agg(F.min("component").alias("m"))
        new = settled(label.join(near.withColumnRenamed("x", "node"), [group, "node"]).select(group, "node", "component", F.least("component", "m").alias("m")))
        if new.where("component <> m").isEmpty():
            return label
        of = new.select(group, F.col("node").alias("m"), F.col("m").alias("further"))
        label = settled(new.join(of, [group, "m"]).select(group, "node", F.least("m", "further").alias("component")))


def subconcepts(occ: DataFrame, parameters: DataFrame, vectors: DataFrame | None = None, least_uses: int = 6, least_names: int = 4, edge: float = 0.25) -> DataFrame:
    """(canonical, qualifier, identifiers) from occurrences (canonical, identifier, file).

    Identifiers of a concept are linked when 0.3 * shared files (3 at most) / 3 + 0.3 * cosine (if positive) + 0.25 *
    Jaccard of parameter subtokens reaches ``edge``; a concept splits if two or more components have two or more
    names. The qualifier is the first subtoken that only the component has. parameters: (identifier, t).
    """
    used = occ.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("identifier").alias("m")).where((F.col("n") >= least_uses) & (F.col("m") >= least_names)).select("canonical")
    names = settled(occ.join(used, "canonical", "left_semi").select("canonical", "identifier", "file").distinct())
    files = names.withColumnRenamed("identifier", "a").join(names.withColumnRenamed("identifier", "b"), ["canonical", "file"]).where("a < b")
    shared = files.groupBy("canonical", "a", "b").agg((F.least(F.count(F.lit(1)), F.lit(3)) / 3 * 0.3).alias("w"))
    sets = parameters.groupBy("identifier").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    toks = parameters.select("identifier", "t").distinct()
    members = names.select("canonical", "identifier").distinct()
    mt = members.join(toks, "identifier")
    common = mt.withColumnRenamed("identifier", "a").join(mt.withColumnRenamed("identifier", "b"), ["canonical", "t"]).where("a < b").groupBy("canonical", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    jac = common.join(sets.select(F.col("identifier").alias("a"), F.size("ts").alias("na")), "a").join(sets.select(F.col("identifier").alias("b"), F.size("ts").alias("nb")), "b")
    parts = [shared, jac.select("canonical", "a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c")) * 0.25).alias("w"))]
    if vectors is not None:
        mv = members.join(vectors.select(F.col("id").alias("identifier"), unit(F.col("vector")).alias("u")), "identifier")
        both = mv.withColumnsRenamed({"identifier": "a", "u": "ua"}).join(mv.withColumnsRenamed({"identifier": "b", "u": "ub"}), "canonical").where("a < b")
        parts.append(both.select("canonical", "a", "b", (F.greatest(dot(F.col("ua"), F.col("ub")), F.lit(0.0)) * 0.3).alias("w")))
    linked = reduce(DataFrame.unionByName, parts).groupBy("canonical", "a", "b").agg(F.sum("w").alias("w")).where(F.col("w") >= edge - 1e-9)
    comp = label_propagation(linked, "canonical")
    big = comp.groupBy("canonical", "component").agg(F.array_sort(F.collect_set("node")).alias("identifiers")).where(F.size("identifiers") >= 2)
    split = big.groupBy("canonical").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    big = big.join(split.select("canonical"), "canonical", "left_semi")
    tokens = big.select("canonical", "component", F.explode("identifiers").alias("i")).select("canonical", "component", F.explode(split_identifier("i")).alias("t")).where("t <> canonical").distinct()
    own = tokens.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("canonical", "t"))).where("k = 1").groupBy("canonical", "component").agg(F.min("t").alias("qualifier"))
    return big.join(own, ["canonical", "component"], "left").select("canonical", F.coalesce("qualifier", "component").alias("qualifier"), "identifiers")
