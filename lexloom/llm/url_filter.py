"""URL filters: rules first, and where none fits, trust and distrust propagated over the links of hosts.

Personalised PageRank from trusted hosts follows links forwards. Distrust from blocked hosts follows them backwards
(who links to bad hosts is suspect): a host's distrust is its links' mean distrust, damped, so it is how likely a walk from
the host ends at a blocked one, and does not shrink when many hosts link to the same blocked one. Both run as one
iteration over one table of links, which is bucketed by its source where it is large, until they converge. All is aggregated
by host before it is joined, and the rows of a hub or of a host with many pages are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Links
from .common import remove, spread_join, written

#: (verdict, host, path): a rule fits its host and all subdomains when the path begins with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rounds end when all values of a host together move by at most TOLERANCE of the whole in EVERY rounds; what lies further than
#: MOST_ROUNDS links away counts less than that anyway.
DAMPING, TOLERANCE, EVERY, MOST_ROUNDS = 0.85, 1e-4, 4, 60
#: A host without a rule is blocked at this distrust, which half its links to blocked hosts give, unless its trust is at
#: least that of an average host.
LEAST, VOUCHED = DAMPING / 2, 1.0
#: Rules up to so many become one expression; more are joined by host.
INLINE_RULES = 200
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UP, _LOW), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``ruled`` (its verdict) of the longest rule that fits; of equally long ones the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    if len(ordered) <= INLINE_RULES:
        fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)) for _, h, p in ordered]
        rule = verdict = F.lit(None).cast("string")
        for fit, (v, h, p) in zip(reversed(fits), reversed(ordered), strict=True):
            rule, verdict = F.when(fit, F.lit(h + p)).otherwise(rule), F.when(fit, F.lit(v)).otherwise(verdict)
        return df.withColumn("rule", rule).withColumn("ruled", verdict)
    table = df.sparkSession.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(ordered)], "v string, h string, p string, i int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = df.select("host", "path").distinct()
    best = near.withColumn("h", F.explode(suffixes)).join(table, "h").where(F.startswith("path", F.col("p"))).groupBy("host", "path").agg(F.min_by(F.struct(F.concat("h", "p").alias("rule"), F.col("v").alias("ruled")), "i").alias("r"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, "r.rule", "r.ruled")


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, every: int = EVERY, most: int = MOST_ROUNDS) -> DataFrame:
    """(id, value) with value = the seed's (id, value) plus ``damping`` times what flows in over edges (source, target, share)."""
    spark, links = edges.sparkSession, Links(edges)
    mass = seeds.agg(F.sum("value")).first()[0] or 0.0
    rank, path = written(seeds, "rank")
    for i in range(every, most + every, every):
        new = rank
        for _ in range(every):
            sent = links.flow(new).select("id", (F.col("value") * F.lit(damping)).alias("value"))
            new = seeds.unionByName(sent).groupBy("id").agg(F.sum("value").alias("value"))
        new, at = written(new, "rank")
        moved = new.withColumnRenamed("value", "x").join(rank, "id", "full").agg(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))))).first()[0] or 0.0
        remove(spark, path)
        rank, path = new, at
        if moved <= tolerance * mass:
            break
    links.drop()
    return rank


def _graph(pages: DataFrame, rules) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages without their html, hosts (host, rows, allowed, blocked), and links between hosts (src, dst, w), as judge() defines them."""
    host, path = host_and_path(F.col("url").cast("string"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    own = ruled(own, rules)
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), lambda x: F.translate(x, _UP, _LOW)))
    # one pass over the pages: what is kept of them has no html
    kept, _ = written(own.select("page_id", "host", "path", "rule", "ruled", links.alias("links")), "urls")
    share = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)) / F.count(F.lit(1)) > 0.5
    hosts, _ = written(kept.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("rows"), share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    pairs = kept.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    pairs, _ = written(pairs, "links")
    return kept, hosts, pairs


def scores(hosts: DataFrame, pairs: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of the hosts that have any.

    trust: a host's share of personalised PageRank from the allowed hosts, times the number of hosts (1 for an average
    one). What a host without links holds returns to the seeds, which is the same as scaling the sum to 1 at the
    end. distrust: 1 for a blocked host, 0 for an allowed one, else ``damping`` times the mean over the host's links.
    """
    tag = lambda kind, host: F.concat(F.lit(kind + ":"), host)
    seeds = hosts.where("allowed or blocked").select(F.when(F.col("allowed"), tag("t", F.col("host"))).otherwise(tag("d", F.col("host"))).alias("id"), F.lit(1.0).alias("value"))
    if pairs.isEmpty():
        values, many = seeds, hosts.count()
    else:
        many = hosts.select("host").unionByName(pairs.select(F.col("dst").alias("host"))).distinct().count()
        out, _ = written(pairs.groupBy("src").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("rows")), "out")
        shared, _ = written(spread_join(pairs, out.select("src", "total"), ["src"], out.select("src", "rows")).select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "shares")
        forth = shared.select(tag("t", F.col("src")).alias("source"), tag("t", F.col("dst")).alias("target"), "share")
        fixed = hosts.where("allowed or blocked").select(F.col("host").alias("src"))
        back = spread_join(shared, fixed, ["src"], out.select("src", "rows"), "left_anti").select(tag("d", F.col("dst")).alias("source"), tag("d", F.col("src")).alias("target"), "share")
        values = propagated(seeds, forth.unionByName(back), damping)
    kind = F.substring("id", 1, 1)
    total = values.where(kind == "t").agg(F.sum("value")).first()[0] or 1.0
    pick = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("value"))), F.lit(0.0))
    return values.groupBy(F.substring("id", 3, 1 << 30).alias("host")).agg(F.round(pick("t") / F.lit(total) * F.lit(float(many)), 4).alias("trust"), F.round(pick("d"), 4).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, least: float = LEAST, vouched: float = VOUCHED) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    verdict is the longest fitting rule's (of equally long ones the first by text), else ``block`` when the host's distrust is
    at least ``least`` and its trust below ``vouched``, else ``allow``. Trusted seeds are the hosts of which rules allow more than
    half the pages, blocked seeds those of which they block more than half. Links are absolute href targets;
    a host's links to itself do not count. A null url, or one without ``://``, has empty host and path,
    takes part in no graph and is allowed; a null html has no links. Repeated rows repeat; other
    columns are ignored; an empty table gives an empty result. Values are rounded to four digits.
    """
    kept, hosts, pairs = _graph(pages, rules)
    found, _ = written(scores(hosts, pairs, damping), "scores")
    bad = (F.col("distrust") >= F.round(F.lit(least), 4)) & (F.col("trust") < vouched)
    joined = spread_join(kept.drop("links"), found, ["host"], hosts.select("host", "rows"), "left").na.fill(0.0, ["trust", "distrust"])
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def oracle(rounds: int = MOST_ROUNDS) -> str:
    """The same in SQL, its rounds written out; they are as many as Spark's at most, so values agree to about TOLERANCE."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda of: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{of(v, h, p)}'" for v, h, p in ordered) + " END"
    low = f"'{_UP}', '{_LOW}'"
    link = LINK.replace("'", "''")
    steps = ["r0 AS (SELECT kind, host, 1.0::double AS value FROM seeds)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT kind, host, sum(value) AS value FROM (SELECT kind, host, 1.0::double AS value FROM seeds UNION ALL "
            f"SELECT e.kind, e.dst, r.value * e.share * {DAMPING}::double FROM r{i - 1} r JOIN edges e ON r.kind = e.kind AND r.host = e.src) GROUP BY ALL)"
        )
    return rf"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {low}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), own AS (
  SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM split
), hosts AS (
  SELECT host, count(*) FILTER (WHERE ruled = 'allow') / count(*) AS a, count(*) FILTER (WHERE ruled = 'block') / count(*) AS b FROM own WHERE host <> '' GROUP BY host
), seeds AS (
  SELECT 't' AS kind, host FROM hosts WHERE a > 0.5 UNION ALL SELECT 'd', host FROM hosts WHERE b > 0.5
), pairs AS (
  SELECT src, dst, count(*)::double AS w FROM (
    SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: translate(x, {low})))) AS dst FROM own WHERE host <> '')
  WHERE src <> dst GROUP BY ALL
), shared AS (
  SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM pairs
), edges AS MATERIALIZED (
  SELECT 't' AS kind, src, dst, share FROM shared UNION ALL SELECT 'd', dst, src, share FROM shared WHERE src NOT IN (SELECT host FROM seeds)
), many AS (SELECT count(*) AS n FROM (SELECT host FROM hosts UNION SELECT dst FROM pairs)
), {", ".join(steps)}, total AS (SELECT sum(value) AS s FROM r{rounds} WHERE kind = 't'
), scores AS (
  SELECT host, round(coalesce(sum(value) FILTER (WHERE kind = 't'), 0) / coalesce((SELECT s FROM total), 1) * (SELECT n FROM many), 4) AS trust,
    round(coalesce(sum(value) FILTER (WHERE kind = 'd'), 0), 4) AS distrust FROM r{rounds} GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust >= {LEAST} AND trust < {VOUCHED} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM own LEFT JOIN scores USING (host)
"""
