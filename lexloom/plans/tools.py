"""The twenty tools and their companions: functions of an ontology and arguments that return DataFrames.

Ties always end on natural keys. An unknown name gives an empty result. Point lookups push their filters into the
relations; nothing is collected except where a text is rendered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import ROLE_SYNONYMS
from ..functions.text import common_directory, format_params, last_part, normalize_type_annotation, scope_root, split_identifier
from ..functions.vectors import centroids, cosine
from ..operators import clusters, embedding, entities, graph
from ..operators import conventions as C
from .ontology import Ontology

LIST_CAP = 350
TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f):
    TOOLS[f.__name__] = f
    return f


def call(tool_name: str, ontology: Ontology, /, **arguments) -> DataFrame:
    """Run a tool by name, as a client would."""
    if tool_name not in TOOLS:
        raise KeyError(f"no tool {tool_name}; there are {', '.join(TOOLS)}")
    return TOOLS[tool_name](ontology, **arguments)


def resolve_concept(o: Ontology, term: str) -> DataFrame:
    """(canonical): by name, else by a subtoken of the term, else by an identifier, else by similarity over 0.5. One row at most.

    A way is tried when those before it found nothing, so that vectors are made only for terms that have no other.
    """
    low = F.lower(F.lit(term))
    c = o.concepts.select("canonical")

    def similar() -> DataFrame:
        vec = F.array(*[F.lit(float(x)) for x in o.embedder.embed([term])[0]])
        return o.concept_vectors.select(F.col("id").alias("canonical"), cosine(F.col("vector"), vec).alias("s")).where("s > 0.5").orderBy(F.desc("s"), "canonical").limit(1).select("canonical")

    ways = [lambda: c.where(F.col("canonical") == low), lambda: c.where(F.array_contains(split_identifier(F.lit(term)), F.col("canonical"))), lambda: o.occurrences.where(F.lower("identifier") == low).select("canonical"), similar]
    for i, way in enumerate(ways):
        if way is similar and (c.isEmpty() or o.concept_vectors is None):
            break
        found = graph.settled(way().groupBy().agg(F.min("canonical").alias("canonical")).where("canonical is not null"))
        if i == len(ways) - 1 or not found.isEmpty():
            break
    return found


def _related(o: Ontology, one: DataFrame, most: int | None = None, kinds: tuple[str, ...] = ("CoOccurs", "SimilarTo", "AbbreviationOf", "Contrastive")) -> DataFrame:
    e = o.links(*kinds)
    both = e.select("source", "target", "kind", "weight").unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", "weight"))
    found = both.join(one.withColumnRenamed("canonical", "source"), "source", "left_semi").select(F.col("target").alias("name"), "kind", "weight")
    return found if most is None else found.orderBy((F.col("kind") == "Contrastive").cast("int").desc(), F.desc("weight"), "name", "kind").limit(most)


@tool
def query_concept(o: Ontology, term: str, max_related: int = 10, max_occurrences: int = 5, max_variants: int = 20, max_signatures: int = 5, max_entities: int = 5) -> DataFrame:
    """(section, rank, name, detail, weight): variants, occurrences, related concepts, conventions, signatures, entities and calls of a concept."""
    one = graph.settled(resolve_concept(o, term))
    names = o.occurrences.join(one, "canonical", "left_semi")
    short = o.links("AbbreviationOf")
    near = short.select(F.col("source").alias("canonical"), "target").unionByName(short.select(F.col("target").alias("canonical"), F.col("source").alias("target")))
    kin = near.join(one, "canonical", "left_semi").select(F.col("target").alias("canonical"))
    held = o.occurrences.join(F.broadcast(one.withColumnRenamed("canonical", "own")), F.contains(F.lower("identifier"), F.col("own"))).select("identifier")
    variants = names.select("identifier").unionByName(held).unionByName(o.occurrences.join(kin, "canonical", "left_semi").select("identifier")).distinct()

    def section(name: str, df: DataFrame, rank: list, label, detail=None, weight=None, most: int | None = None) -> DataFrame:
        detail = F.lit(None).cast("string") if detail is None else detail
        weight = F.lit(None).cast("double") if weight is None else weight.cast("double")
        w = Window.orderBy(*rank)
        top = df if most is None else df.orderBy(*rank).limit(most)
        return top.select(F.lit(name).alias("section"), F.row_number().over(w).alias("rank"), label.alias("name"), detail.alias("detail"), weight.alias("weight"))

    sig = o.signatures.join(F.broadcast(one), F.contains(F.lower("name"), F.col("canonical")))
    sig = sig.select("name", F.concat(F.lit("("), F.array_join(format_params(F.col("params")), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "return_type"), F.lit(""))).alias("text"), "file", "line")
    ent = o.entities.join(F.broadcast(one), F.array_contains("tags", F.col("canonical"))).select("name", "kind", "file", "line")
    conv = o.conventions.select("kind", "value", "semantic_role", "frequency", F.explode("examples").alias("identifier")).join(names.select("identifier").distinct(), "identifier", "left_semi").select("kind", "value", "semantic_role", "frequency").distinct()
    parts = [
        section("variant", variants, ["identifier"], F.col("identifier"), most=max_variants),
        section("occurrence", names, ["file", "line", "identifier"], F.col("identifier"), F.concat_ws(":", "file", F.col("line").cast("string")), most=max_occurrences),
        section("related", _related(o, one, max_related), [(F.col("kind") == "Contrastive").cast("int").desc(), F.desc("weight"), "name"], F.col("name"), F.col("kind"), F.col("weight")),
        section("convention", conv, [F.desc("frequency"), "kind", "value"], F.col("value"), F.col("semantic_role"), F.col("frequency")),
        section("signature", sig, ["name", "file", "line"], F.col("name"), F.col("text"), most=max_signatures),
        section("entity", ent, ["name", "file", "line"], F.col("name"), F.col("kind"), most=max_entities),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identifier_counts(occurrences: DataFrame) -> DataFrame:
    """(identifier lower-cased, n): rows over all concepts, so an identifier counts once for each concept it has."""
    return occurrences.groupBy(F.lower("identifier").alias("identifier")).agg(F.count(F.lit(1)).alias("n"))


def check_names(asked: DataFrame, concepts: DataFrame, occurrences: DataFrame, conventions: DataFrame) -> DataFrame:
    """(input, verdict, suggestion, convention, confidence) of many identifiers (input) at once.

    Inconsistent: it is used, but a related name is used more; or its count prefix is not the project's. Consistent: it
    follows a convention, or it is used. Unknown otherwise. Related: a concept's identifiers where a subtoken contains
    the concept or is contained in it, the concept itself if used as a name, and concepts that a subtoken begins.
    """
    counts = graph.settled(identifier_counts(occurrences))
    own = graph.settled(asked.select("input").distinct().withColumn("low", F.lower("input")).join(counts.withColumnsRenamed({"identifier": "low", "n": "used"}), "low", "left").na.fill(0, ["used"]))
    toks = own.select("low", F.explode(split_identifier("input")).alias("t")).distinct()
    words = toks.select("t").distinct()
    total = occurrences.groupBy("canonical").agg(F.count(F.lit(1)).alias("uses"))
    # concepts against the distinct subtokens of what is asked, with the vocabulary as the side that is broadcast while small
    close = words.join(graph.small(concepts.select("canonical")), F.contains("t", F.col("canonical")) | F.contains(F.col("canonical"), F.col("t")))
    close = graph.settled(close)
    per = occurrences.groupBy("canonical", F.lower("identifier").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_name = close.join(per, "canonical").select("t", "name", "n")
    by_self = close.join(counts.withColumnsRenamed({"identifier": "canonical"}), "canonical").select("t", F.col("canonical").alias("name"), "n")
    begun = close.where((F.length("t") >= 2) & (F.length("canonical") > F.length("t")) & F.startswith("canonical", F.col("t"))).join(total, "canonical").select("t", F.col("canonical").alias("name"), F.col("uses").alias("n"))
    best_t = by_name.unionByName(by_self).unionByName(begun).groupBy("t", "name").agg(F.max("n").alias("n"))
    best = toks.join(best_t, "t").where("name <> low").groupBy("low").agg(F.min(F.struct((-F.col("n")).alias("m"), "name")).alias("b")).select("low", F.col("b.name").alias("best"), (-F.col("b.m")).alias("best_n"))
    prefix = conventions.where("kind = 'Prefix' and value in ('n_', 'nb_', 'num_')").orderBy(F.desc("frequency"), "value").limit(1).select(F.col("value").alias("count_prefix"))
    conv = graph.small(graph.settled(conventions.select("kind", "value", "frequency")))
    fits = own.join(conv, C.matches(F.col("input"), F.col("kind"), F.col("value"))).groupBy("low").agg(F.min(F.struct((-F.col("frequency")).alias("m"), "kind", "value")).alias("c")).select("low", F.col("c.value").alias("convention"))
    j = own.join(best, "low", "left").join(fits, "low", "left").join(F.broadcast(prefix), F.lit(True), "left")
    worse = (F.col("used") > 0) & (F.col("best_n") > F.col("used"))
    alt = F.regexp_extract("low", "^(n_|nb_|num_)", 1)
    odd = F.col("count_prefix").isNotNull() & (alt != "") & (alt != F.col("count_prefix"))
    ratio = (1 - F.col("used") / F.col("best_n")) * F.least(F.log2(F.col("used") + F.col("best_n")) / 4, F.lit(1.0))
    verdict = F.when(worse | odd, "Inconsistent").when(F.col("convention").isNotNull() | (F.col("used") > 0), "Consistent").otherwise("Unknown")
    confidence = F.when(worse, F.greatest(F.lit(0.0), F.least(ratio, F.lit(1.0)))).when(odd | F.col("convention").isNotNull(), 0.8).when(F.col("used") > 0, 0.6).otherwise(0.0)
    suggestion = F.when(worse, F.col("best")).when(odd, F.concat("count_prefix", F.expr("substring(low, length(regexp_extract(low, '^(n_|nb_|num_)', 1)) + 1)")))
    return j.select("input", verdict.alias("verdict"), suggestion.alias("suggestion"), F.when(~worse | worse.isNull(), F.when(odd, F.col("count_prefix")).otherwise(F.col("convention"))).alias("convention"), F.round(confidence, 6).alias("confidence"))


@tool
def check_naming(o: Ontology, identifier: str) -> DataFrame:
    asked = o.concepts.sparkSession.createDataFrame([(identifier,)], "input string")
    return check_names(asked, o.concepts, o.occurrences, o.conventions)


@tool
def suggest_name(o: Ontology, description: str) -> DataFrame:
    """(name, confidence): at most five names for a description, from the concepts its words match and a convention for its role."""
    spark = o.concepts.sparkSession
    words = [w.lower() for w in description.split()]
    w = spark.createDataFrame([(x,) for x in dict.fromkeys(words)], "w string")
    uses = o.occurrences.groupBy("canonical").agg(F.count(F.lit(1)).alias("uses"), F.collect_set("identifier").alias("ids"))
    c = o.concepts.select("canonical").join(uses, "canonical", "left")
    long = (F.length("w") >= 3) & (F.length("canonical") >= 3)
    score = F.when(long & (F.col("w") == F.col("canonical")), 0.85).when(long & (F.startswith("w", F.col("canonical")) | F.startswith("canonical", F.col("w"))), 0.80).when(F.col("w") == F.col("canonical"), 0.80)
    hits = c.join(F.broadcast(w), score.isNotNull()).groupBy("canonical").agg(F.max(score).alias("raw"))
    if o.concept_vectors is not None:
        vec = F.array(*[F.lit(float(x)) for x in o.embedder.embed([description])[0]])
        like = o.concept_vectors.select(F.col("id").alias("canonical"), cosine(F.col("vector"), vec).alias("raw")).where("raw >= 0.4").orderBy(F.desc("raw"), "canonical").limit(10)
        hits = hits.unionByName(like).groupBy("canonical").agg(F.max("raw").alias("raw"))
    hits = graph.settled(hits.join(c, "canonical"))
    e = o.links("AbbreviationOf")
    known = hits.select("canonical")
    linked = e.join(known.withColumnRenamed("canonical", "source"), "source", "left_semi").join(known.withColumnRenamed("canonical", "target"), "target", "left_semi")
    linked = linked.select(F.col("source").alias("canonical")).unionByName(linked.select(F.col("target").alias("canonical"))).distinct().withColumn("linked", F.lit(0.05))
    value = F.least(F.col("raw") + F.when(F.col("canonical").isin(words), 0.10).otherwise(0.0) + F.coalesce("linked", F.lit(0.0)) + F.log(F.coalesce("uses", F.lit(0)) + 1.0) * 0.02, F.lit(0.99))
    top = hits.join(linked, "canonical", "left").withColumn("s", value).orderBy(F.desc("s"), "canonical").limit(5)
    roles = sorted({ROLE_SYNONYMS[x] for x in words if x in ROLE_SYNONYMS} | set(words))
    conv = o.conventions.where(F.col("semantic_role").isin(roles)).orderBy(F.desc("frequency"), "kind", "value").limit(1).select(F.col("kind").alias("ck"), F.col("value").alias("cv"))
    shaped = top.crossJoin(F.broadcast(conv)).withColumn("name", F.when(F.col("ck") == "Prefix", F.concat("cv", "canonical")).when(F.col("ck") == "Suffix", F.concat("canonical", "cv")).otherwise(F.concat("canonical", "cv", F.lit("x"))))
    exists = F.array_contains("ids", F.col("name"))
    shaped = shaped.select("name", F.when(F.col("ck") == "Conversion", F.col("s") * 0.4 + 0.2).when(exists, F.least(F.col("s") * 0.5 + 0.45, F.lit(0.95))).otherwise(F.least(F.col("s") * 0.4 + 0.25, F.lit(0.80))).alias("confidence"))
    plain = top.select(F.col("canonical").alias("name"), F.least(F.col("s") * 0.85, F.lit(0.92)).alias("confidence"))
    return shaped.unionByName(plain).groupBy("name").agg(F.round(F.max("confidence"), 6).alias("confidence")).orderBy(F.desc("confidence"), "name").limit(5)


def concept_states(concepts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(canonical, n, names) of a snapshot."""
    return concepts.select("canonical").join(occurrences.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("identifier")).alias("names")), "canonical")


def diff_states(base: DataFrame, head: DataFrame) -> DataFrame:
    """(change, canonical, delta, added, removed) of two snapshots (canonical, n, names); unchanged concepts are left out."""
    b, h = base.select("canonical", F.col("n").alias("bn"), F.col("names").alias("b")), head.select("canonical", F.col("n").alias("hn"), F.col("names").alias("h"))
    j = b.join(h, "canonical", "full")
    none = F.array().cast("array<string>")
    j = j.select(
        F.when(F.col("bn").isNull(), "added").when(F.col("hn").isNull(), "removed").otherwise("changed").alias("change"), "canonical", (F.coalesce("hn", F.lit(0)) - F.coalesce("bn", F.lit(0))).alias("delta"),
        F.array_sort(F.array_except(F.coalesce("h", none), F.coalesce("b", none))).alias("added"), F.array_sort(F.array_except(F.coalesce("b", none), F.coalesce("h", none))).alias("removed"),
    )
    return j.where("change <> 'changed' or delta <> 0 or size(added) > 0 or size(removed) > 0")


def ontology_diff(base: Ontology, head: Ontology, caps: tuple[int, int, int] = (40, 40, 50), variants: int = 5) -> DataFrame:
    """The largest changes: by frequency, then name; both sides analysed alike."""
    d = diff_states(concept_states(base.concepts, base.occurrences), concept_states(head.concepts, head.occurrences))
    out = [d.where(F.col("change") == k).orderBy(F.desc(F.abs("delta")), "canonical").limit(n) for k, n in zip(("added", "removed", "changed"), caps, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("change", "canonical", "delta", F.slice("added", 1, variants).alias("added"), F.slice("removed", 1, variants).alias("removed"))


@tool
def list_concepts(o: Ontology, top_k: int = 200) -> DataFrame:
    n = o.occurrences.groupBy("canonical").agg(F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("entity_type")).alias("entity_types"))
    tagged = o.entities.select(F.explode("tags").alias("canonical")).groupBy("canonical").agg(F.count(F.lit(1)).alias("entities"))
    return n.join(tagged, "canonical", "left").na.fill(0, ["entities"]).orderBy(F.desc("occurrences"), "canonical").limit(min(top_k, LIST_CAP))


@tool
def list_conventions(o: Ontology) -> DataFrame:
    return o.conventions.orderBy(F.desc("frequency"), "kind", "value")


@tool
def describe_symbol(o: Ontology, name: str) -> DataFrame:
    """(section, name, detail): kind and signature, callers, callees, concepts, related entities of a symbol."""
    low = name.lower()
    kind = F.create_map(*[F.lit(x) for p in (("class", 0), ("method", 1), ("function", 2)) for x in p])
    own = o.entities.where(F.lower("name") == low).orderBy(kind[F.col("kind")], "file", "line").limit(1)
    sig = o.signatures.where(F.lower("name") == low).orderBy("file", "line").limit(1)
    head = sig.select(F.lit("signature").alias("section"), "name", F.concat(F.array_join(format_params(F.col("params")), ", "), F.lit(" -> "), F.coalesce("return_type", F.lit("?"))).alias("detail"))
    cls = o.classes.where(F.lower("name") == low).orderBy("file", "line").limit(1).select(F.lit("class").alias("section"), "name", F.array_join("methods", ", ").alias("detail"))
    what = own.select(F.lit("kind").alias("section"), "name", F.col("kind").alias("detail"))
    callers = o.call_sites.where((F.lower("callee") == low) | F.endswith(F.lower("callee"), F.lit("." + low))).select(F.lit("caller").alias("section"), F.coalesce("caller_scope", F.lit("<module>")).alias("name"), "file").distinct().withColumnRenamed("file", "detail")
    callees = o.call_sites.where((F.lower("caller_scope") == low) | F.endswith(F.lower("caller_scope"), F.lit("." + low))).select(F.lit("callee").alias("section"), F.col("callee").alias("name"), "file").distinct().withColumnRenamed("file", "detail")
    tags = own.select(F.lit("concept").alias("section"), F.explode("tags").alias("name"), F.lit(None).cast("string").alias("detail"))
    e = o.links("InheritsFrom", "Uses", "MemberOf")
    both = e.select(F.col("source").alias("id"), F.col("target").alias("other"), "kind").unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("other"), "kind"))
    rel = both.join(own.select("id"), "id", "left_semi").join(o.entities.select(F.col("id").alias("other"), "name"), "other").select(F.lit("related").alias("section"), "name", F.col("kind").alias("detail")).distinct()
    out = what
    for x in (head, cls, callers, callees, tags, rel):
        out = out.unionByName(x)
    return out


@tool
def describe_file(o: Ontology, path: str) -> DataFrame:
    """(file, line, kind, name, parent): classes with their methods and functions of the files whose path ends with ``path``."""
    return file_outline(o.signatures, o.classes).where(F.endswith("file", F.lit(path))).orderBy("file", "line", "kind", "name")


def file_outline(signatures: DataFrame, classes: DataFrame) -> DataFrame:
    names = classes.select(F.col("name").alias("root")).distinct().withColumn("known", F.lit(True))
    s = signatures.withColumn("root", scope_root(F.col("scope"))).join(names, "root", "left")
    fn = s.select("file", "line", F.when(F.col("known"), "method").otherwise("function").alias("kind"), "name", F.when(F.col("known"), F.col("root")).alias("parent"))
    return classes.select("file", "line", F.lit("class").alias("kind"), "name", F.lit(None).cast("string").alias("parent")).unionByName(fn)


def nesting_tree(o: Ontology, path: str) -> DataFrame:
    """The nesting rows of the first file whose path ends with ``path``."""
    first = o.nesting.where(F.endswith("file", F.lit(path))).agg(F.min("file").alias("file"))
    return o.nesting.join(F.broadcast(first), "file", "left_semi").orderBy("node_id")


@tool
def locate_concept(o: Ontology, term: str) -> DataFrame:
    """(section, name, file, score): signatures, classes and files where a concept lives, what it contrasts with, key entities."""
    one = graph.settled(resolve_concept(o, term.split(".")[0]))
    names = o.occurrences.join(one, "canonical", "left_semi")
    ids = names.select(F.col("identifier").alias("name")).distinct().withColumn("hit", F.lit(True))
    held = F.contains(F.lower("name"), F.col("canonical"))
    s = o.signatures.crossJoin(F.broadcast(one)).join(F.broadcast(ids), "name", "left")
    sig = s.withColumn("score", F.when(F.col("hit"), 3).when(held, 2).otherwise(0) + F.size(F.filter("params", lambda p: F.contains(F.lower(p["name"]), F.col("canonical"))))).where("score > 0")
    sig = sig.orderBy(F.desc("score"), "name", "file", "line").limit(5).select(F.lit("signature").alias("section"), "name", "file", F.col("score").cast("double").alias("score"))
    c = o.classes.crossJoin(F.broadcast(one)).join(F.broadcast(ids), "name", "left")
    cls = c.withColumn("score", F.when(F.coalesce("hit", F.lit(False)) | held, 3).otherwise(0) + F.size(F.filter("methods", lambda m: F.contains(F.lower(m), F.col("canonical"))))).where("score > 0")
    cls = cls.orderBy(F.desc("score"), "name", "file", "line").limit(3).select(F.lit("class").alias("section"), "name", "file", F.col("score").cast("double").alias("score"))
    files = names.groupBy("file").agg(F.count(F.lit(1)).cast("double").alias("score")).select(F.lit("file").alias("section"), F.lit(None).cast("string").alias("name"), "file", "score")
    apart = _related(o, one, kinds=("Contrastive",)).select(F.lit("contrast").alias("section"), "name", F.lit(None).cast("string").alias("file"), F.col("weight").alias("score"))
    ent = o.entities.join(F.broadcast(one), F.array_contains("tags", F.col("canonical"))).drop("canonical")
    key = _ranked(o, ent, 5).select(F.lit("entity").alias("section"), "name", "file", F.col("density").alias("score"))
    out = sig
    for x in (cls, files, apart, key):
        out = out.unionByName(x)
    return out


def _ranked(o: Ontology, ents: DataFrame, k: int) -> DataFrame:
    """Entities with density and nearest concept cluster, the first k taken from clusters in turn."""
    counts = o.occurrences.groupBy("canonical").agg(F.count(F.lit(1)).alias("total"))
    dense = entities.density(ents, counts)
    if o.concept_vectors is None:
        return clusters.diverse(dense.withColumn("label", F.lit(None).cast("string")), k)
    cents = centroids(o.concept_vectors.join(o.concept_clusters, "id"), "label", "vector")
    tags = ents.select(F.col("id").alias("e"), F.explode("tags").alias("id")).join(o.concept_vectors, "id").select(F.col("e").alias("id"), "vector")
    means = centroids(tags.select(F.col("id"), "vector"), "id", "vector").withColumnRenamed("centroid", "vector")
    return clusters.diverse(dense.join(clusters.nearest_centroid(means, cents).select("id", "label"), "id", "left"), k)


@tool
def list_entities(o: Ontology, concept: str | None = None, role: str | None = None, kind: str | None = None, top_k: int = 20) -> DataFrame:
    """Entities by concept, role (part of it, any case) and kind. An unknown concept gives none."""
    e = o.entities
    if concept:
        e = e.join(F.broadcast(resolve_concept(o, concept)), F.array_contains("tags", F.col("canonical"))).drop("canonical")
    if role:
        e = e.where(F.contains(F.lower("semantic_role"), F.lit(role.lower())))
    if kind:
        e = e.where(F.col("kind") == kind.lower())
    return _ranked(o, e, top_k).select("name", "kind", "semantic_role", "tags", "file", "line", "density", "label")


def coverage(occurrences: DataFrame, conventions: DataFrame) -> DataFrame:
    """(identifier, covered): whether any convention fits each distinct identifier."""
    names = occurrences.select("identifier").distinct()
    conv = graph.small(graph.settled(conventions.select("kind", "value")))
    hit = names.join(conv, C.matches(F.col("identifier"), F.col("kind"), F.col("value")), "left_semi").withColumn("covered", F.lit(True))
    return names.join(hit, "identifier", "left").na.fill(False, ["covered"])


def health(occurrences: DataFrame, conventions: DataFrame, vectors: DataFrame | None = None, weights: tuple[float, float, float] = (0.33, 0.33, 0.33)) -> DataFrame:
    """One row: coverage, consistency, cohesion, health; null where there is no concept to average over."""
    cov = occurrences.join(coverage(occurrences, conventions), "identifier").groupBy("canonical").agg(F.max(F.col("covered").cast("int")).alias("c"), (1 - (F.countDistinct("identifier") - 1) / F.count(F.lit(1))).alias("s"))
    one = cov.agg(F.avg("c").alias("coverage"), F.avg("s").alias("consistency"))
    if vectors is None:
        one = one.withColumn("cohesion", F.lit(1.0))
    else:
        near = vectors.join(centroids(vectors, "label", "vector"), "label").groupBy("label").agg(F.avg(cosine(F.col("vector"), F.col("centroid"))).alias("c"))
        one = one.crossJoin(near.agg(F.coalesce(F.avg("c"), F.lit(1.0)).alias("cohesion")))
    return one.withColumn("health", _health(weights))


def _health(weights: tuple[float, float, float]):
    a, b, c = weights
    return (F.col("coverage") * a + F.col("consistency") * b + F.col("cohesion") * c) / (a + b + c)


def inconsistencies(occurrences: DataFrame, most: int = 10) -> DataFrame:
    """(canonical, dominant, minority, gap): the identifiers of a concept most behind its most used one."""
    n = occurrences.groupBy("canonical", "identifier").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("canonical").orderBy(F.desc("n"), "identifier")
    r = n.withColumn("dominant", F.first("identifier").over(w)).withColumn("top", F.first("n").over(w)).where("identifier <> dominant")
    return r.select("canonical", "dominant", F.col("identifier").alias("minority"), (F.col("top") - F.col("n")).alias("gap")).orderBy(F.desc("gap"), "canonical", "minority").limit(most)


@tool
def vocabulary_health(o: Ontology, weights: tuple[float, float, float] = (0.33, 0.33, 0.33)) -> DataFrame:
    v = o.concept_vectors.join(o.concept_clusters, "id") if o.concept_vectors is not None else None
    # without concepts nothing is covered and nothing is inconsistent
    return health(o.occurrences, o.conventions, v, weights).na.fill({"coverage": 0.0, "consistency": 1.0}).withColumn("health", _health(weights))


@tool
def session_briefing(o: Ontology) -> DataFrame:
    """(section, name, detail): conventions, abbreviations, top concepts, contrasts, doubtful names, role groups."""
    text = lambda x: x.cast("string")
    row = lambda df, s, n, d: df.select(F.lit(s).alias("section"), n.alias("name"), d.alias("detail"))
    asked = check_names(o.concepts.select(F.col("canonical").alias("input")), o.concepts, o.occurrences, o.conventions).where("verdict = 'Inconsistent'")
    roles = o.entities.where("semantic_role <> ''").withColumn("rn", F.row_number().over(Window.partitionBy("semantic_role").orderBy("name", "file", "line")))
    groups = roles.groupBy("semantic_role").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("rn") <= 5, F.col("name")))).alias("ex")).where("n >= 2")
    parts = [
        row(o.conventions, "convention", F.col("value"), F.col("semantic_role")),
        row(o.links("AbbreviationOf"), "abbreviation", F.col("source"), F.col("target")),
        row(list_concepts(o, 20), "concept", F.col("canonical"), text(F.col("occurrences"))),
        row(o.links("Contrastive"), "contrast", F.col("source"), F.col("target")),
        row(asked, "inconsistent", F.col("input"), F.col("suggestion")),
        row(groups, "role", F.col("semantic_role"), F.array_join("ex", ", ")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@tool
def concept_map(o: Ontology, root: str | None = None) -> DataFrame:
    return module_map(o.entities, root)


def module_map(ents: DataFrame, root: str | None = None) -> DataFrame:
    """(directory, classes, functions, total, density, concepts): entities by directory below ``root`` or else their common one, largest first."""
    e = ents.withColumn("dir", F.regexp_replace("file", r"/?[^/]*$", ""))
    if root is None:
        top = e.agg(common_directory(F.array_distinct(F.collect_set(F.concat("dir", F.lit("/x"))))).alias("root"))
        rel = F.when(F.col("root") == "", F.col("dir")).otherwise(F.expr("substring(dir, length(root) + 2)"))
        e = e.crossJoin(F.broadcast(top)).withColumn("directory", F.when(rel == "", ".").otherwise(rel))
    else:
        inside = F.startswith("dir", F.lit(f"{root}/"))
        e = e.withColumn("directory", F.when(F.col("dir") == root, ".").when(inside, F.substring("dir", F.lit(len(root) + 2), F.length("dir"))).otherwise(F.col("dir")))
    n = e.groupBy("directory").agg(F.sum((F.col("kind") == "class").cast("long")).alias("classes"), F.sum((F.col("kind") != "class").cast("long")).alias("functions"), F.count(F.lit(1)).alias("total"), F.avg(F.size("tags")).alias("density"))
    t = e.select("directory", F.explode("tags").alias("t")).groupBy("directory", "t").agg(F.count(F.lit(1)).alias("c")).withColumn("rn", F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("c"), "t"))).where("rn <= 5")
    best = t.groupBy("directory").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda s: s["t"]).alias("concepts"))
    return n.join(best, "directory", "left").orderBy(F.desc("total"), "directory")


def typed(signatures: DataFrame) -> DataFrame:
    """(callee, type, kind): what the first signature of each name returns and takes. A type is read once, whatever calls it."""
    first = signatures.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("file", "line"))).where("rn = 1")
    back = first.where("return_type is not null").select(F.col("name").alias("callee"), F.col("return_type").alias("type"), F.lit("return").alias("kind"))
    into = first.select(F.col("name").alias("callee"), F.explode("params").alias("p")).where("p.type_annotation is not null").select("callee", F.col("p.type_annotation").alias("type"), F.lit("parameter").alias("kind"))
    return back.unionByName(into).withColumn("type", normalize_type_annotation("type"))


def flows(signatures: DataFrame, call_sites: DataFrame, holds: str | None = None) -> DataFrame:
    """(source, target, type, kind): return types flow from callee to caller, parameter types from caller to callee.

    A call is typed by the first signature of exactly its callee's name. ``holds``: of types that contain this text, in any case.
    """
    types = typed(signatures)
    if holds is not None:
        types = types.where(F.contains(F.lower("type"), F.lit(holds.lower())))
    j = call_sites.select(F.coalesce("caller_scope", F.lit("<module>")).alias("caller"), "callee").join(types, "callee")
    back = F.col("kind") == "return"
    return j.select(F.when(back, F.col("callee")).otherwise(F.col("caller")).alias("source"), F.when(back, F.col("caller")).otherwise(F.col("callee")).alias("target"), "type", "kind")


def flow_counts(signatures: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(type, flows): how often each type flows. Calls are counted by callee before they meet types."""
    calls = call_sites.groupBy("callee").agg(F.count(F.lit(1)).alias("n"))
    return typed(signatures).join(calls, "callee").groupBy("type").agg(F.sum("n").alias("flows"))


@tool
def type_flows(o: Ontology) -> DataFrame:
    """(type, flows): how often each type flows."""
    return flow_counts(o.signatures, o.call_sites).orderBy(F.desc("flows"), "type")


@tool
def trace_type(o: Ontology, type_name: str) -> DataFrame:
    return flows(o.signatures, o.call_sites, type_name).orderBy("source", "target", "kind", "type")


@tool
def trace_concept(o: Ontology, concept: str, max_depth: int = 5) -> DataFrame:
    """(place, name, role): entities that produce or consume a concept and what bridges them, in topological order."""
    one = graph.settled(resolve_concept(o, concept))
    calls = o.call_sites.where("caller_scope is not null").select(last_part(F.col("caller_scope")).alias("source"), last_part(F.col("callee")).alias("target"))
    names = o.entities.select("id", "name")
    e = o.links("Uses", "InheritsFrom").join(names.withColumnsRenamed({"id": "source", "name": "s"}), "source").join(names.withColumnsRenamed({"id": "target", "name": "t"}), "target").select(F.col("s").alias("source"), F.col("t").alias("target"))
    edges = graph.settled(calls.unionByName(e).where("source <> target").distinct())
    own = o.entities.where(F.lower("name") == concept.lower()).select("name").distinct()
    known = o.entities.select("name").distinct()
    if not own.isEmpty():
        back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
        reach = graph.reach(own.select(F.col("name").alias("id")), edges, max_depth).unionByName(graph.reach(own.select(F.col("name").alias("id")), back, max_depth))
        picked = reach.select(F.col("id").alias("name")).distinct().join(known, "name", "left_semi")
    else:
        seeds = graph.settled(o.entities.join(F.broadcast(one), F.array_contains("tags", F.col("canonical"))).select("name").distinct())
        roles = _roles(o, seeds, one)
        ahead = graph.reach(roles.where("role <> 'Consumer'").select(F.col("name").alias("id")), edges, max_depth)
        behind = graph.reach(roles.where("role <> 'Producer'").select(F.col("name").alias("id")), edges.select(F.col("target").alias("source"), F.col("source").alias("target")), max_depth)
        bridges = ahead.select("id").intersect(behind.select("id")).select(F.col("id").alias("name"))
        near = edges.join(seeds.withColumnRenamed("name", "source"), "source", "left_semi").select(F.col("target").alias("name")).unionByName(edges.join(seeds.withColumnRenamed("name", "target"), "target", "left_semi").select(F.col("source").alias("name")))
        picked = seeds.unionByName(bridges).unionByName(near.join(known, "name", "left_semi")).distinct()
    picked = graph.settled(picked)
    inner = edges.join(picked.withColumnRenamed("name", "source"), "source", "left_semi").join(picked.withColumnRenamed("name", "target"), "target", "left_semi")
    # a trace is what a reader follows: the subgraph of one concept, ordered on the driver
    order = graph.topological_order([r.name for r in picked.collect()], [(r.source, r.target) for r in inner.collect()])
    spark = o.concepts.sparkSession
    placed = spark.createDataFrame([(i, n) for i, n in enumerate(order)], "place int, name string")
    return placed.join(_roles(o, picked, one), "name", "left").select("place", "name", F.coalesce("role", F.lit("Bridge")).alias("role")).orderBy("place")


def _roles(o: Ontology, names: DataFrame, one: DataFrame) -> DataFrame:
    """(name, role): Producer if the return type has the concept, Consumer if a parameter has it, Both for both or neither."""
    s = o.signatures.join(names, "name", "left_semi").crossJoin(F.broadcast(one))
    has = lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), F.col("canonical"))
    r = s.groupBy("name").agg(F.max(has(F.col("return_type"))).alias("p"), F.max(F.exists("params", lambda x: has(x["name"]) | has(x["type_annotation"]))).alias("c"))
    j = names.join(r, "name", "left")
    return j.select("name", F.when(F.col("p") & ~F.col("c"), "Producer").when(F.col("c") & ~F.col("p"), "Consumer").otherwise("Both").alias("role"))


@tool
def describe_logic(o: Ontology, name: str) -> DataFrame:
    """(name, body, cluster, behaviour, members, in_degree, out_degree, pagerank) of the entities of a name."""
    own = o.entities.where(F.lower("name") == name.lower()).select("id", "name", "file")
    bodies = o.bodies.select(F.col("entity_name").alias("name"), "file", F.col("body_text").alias("body"))
    out = own.join(bodies, ["name", "file"], "left").join(o.centrality, "id", "left").na.fill(0, ["in_degree", "out_degree"]).na.fill(0.0, ["pagerank"])
    if o.logic_clusters is None:
        return out.withColumn("cluster", F.lit(None).cast("string")).drop("id", "file")
    named = o.logic_clusters.join(o.entities.select("id", F.col("name").alias("member")), "id")
    groups = named.groupBy("label").agg(F.array_sort(F.collect_set("member")).alias("members"), F.first("behaviour").alias("behaviour"))
    return out.join(o.logic_clusters.select("id", "label"), "id", "left").join(groups, "label", "left").drop("id", "file").withColumnRenamed("label", "cluster")


@tool
def find_similar_logic(o: Ontology, name: str, top_k: int = 5) -> DataFrame:
    """(name, file, score): the entities with the most similar bodies; none for an unknown name or without vectors."""
    first = o.entities.where(F.lower("name") == name.lower()).join(o.logic_vectors.select("id"), "id", "left_semi").agg(F.min("id").alias("id")).where("id is not null")
    q = o.logic_vectors.join(F.broadcast(first), "id", "left_semi")
    return clusters.nearest(q, o.logic_vectors, top_k).join(o.entities.select("id", "name", "file"), "id").select("rank", "name", "file", "score").orderBy("rank")


@tool
def compact_context(o: Ontology, scope: str, max_tokens: int = 500) -> DataFrame:
    """One row (text, tokens): what is known of an entity, file or concept, cut section by section to a budget."""
    titles = ["Structure", "Behavior", "Domain", "Related"]
    d = describe_symbol(o, scope)
    if d.isEmpty():
        d = describe_file(o, scope).select(F.col("kind").alias("section"), "name", F.col("parent").alias("detail"))
    if d.isEmpty():
        d = query_concept(o, scope).select("section", "name", "detail")
    of = {"kind": 0, "signature": 0, "class": 0, "method": 0, "function": 0, "caller": 1, "callee": 1, "occurrence": 1, "concept": 2, "convention": 2, "variant": 2}
    place = F.coalesce(F.create_map(*[F.lit(x) for p in of.items() for x in p])[F.col("section")], F.lit(3))
    d = graph.settled(d.withColumn("place", place))
    counted = {r.place: r.n for r in d.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    # all rows count; of those of a section, no more are fetched than have room in the budget
    room = max_tokens * 4 // len("- x y\n") + 1
    line = lambda r: f"- {r.section} {r.name}" + (f": {r.detail}" if r.detail else "")
    lines = [[line(r) for r in d.where(F.col("place") == i).orderBy("section", "name", "detail").limit(room).collect()] if i in counted else [] for i in range(len(titles))]
    keep = [counted.get(i, 0) for i in range(len(titles))]
    render = lambda: "\n".join(f"## {s}\n" + "\n".join(x[:k]) for s, x, k in zip(titles, lines, keep, strict=True) if k)
    while any(keep) and (any(k > len(x) for k, x in zip(keep, lines, strict=True)) or len(render().encode()) / 4 > max_tokens):
        last = max(i for i, k in enumerate(keep) if k)
        keep[last] //= 2
    text = render()
    return o.concepts.sparkSession.createDataFrame([(text, len(text.encode()) // 4)], "text string, tokens int")


@tool
def export_domain_pack(o: Ontology) -> DataFrame:
    """(section, name, detail, rank): at most 30 abbreviations, 30 conventions, 50 terms and 50 associations."""
    return pack_rows(o.concepts, o.occurrences, o.conventions, o.links("AbbreviationOf", "Contrastive"), o.concept_clusters)


def pack_rows(concepts: DataFrame, occurrences: DataFrame, conventions: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    def top(section: str, df: DataFrame, name, detail, order: list, n: int) -> DataFrame:
        t = df.select(name.alias("name"), detail.cast("string").alias("detail"), *[(o if not isinstance(o, str) else F.col(o)).alias(f"k{i}") for i, o in enumerate(order)])
        keys = [f"k{i}" for i in range(len(order))]
        t = t.orderBy(*keys).limit(n)
        return t.select(F.lit(section).alias("section"), "name", "detail", F.row_number().over(Window.orderBy(*keys)).alias("rank"))

    uses = occurrences.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        top("abbreviation", edges.where("kind = 'AbbreviationOf'"), F.col("source"), F.col("target"), ["source", "target"], 30),
        top("convention", conventions, F.col("value"), F.col("semantic_role"), [-F.col("frequency"), "kind", "value"], 30),
        top("term", concepts.select("canonical").join(uses, "canonical"), F.col("canonical"), F.col("n"), [-F.col("n"), "canonical"], 50),
        top("association", edges.where("kind = 'Contrastive'"), F.col("source"), F.col("target"), ["source", "target"], 50),
    ]
    if labels is not None:
        g = labels.groupBy("label").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 8).alias("ids")).where(F.size("ids") >= 2)
        parts.append(top("cluster", g, F.col("label"), F.array_join("ids", ", "), ["label"], 50))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@tool
def generate_ontology_md(o: Ontology) -> DataFrame:
    """(markdown), a row a line: the top 20 concepts, entities and co-occurrences, and all conventions and abbreviations.

    Lines are sorted by Spark, so no section is gathered; write_markdown() puts them into a file.
    """
    spark = o.concepts.sparkSession
    none, text = F.lit(""), lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    top = o.centrality.join(o.entities.select("id", "name", "kind", "semantic_role"), "id").orderBy(F.desc("pagerank"), "name").limit(20)
    co = o.links("CoOccurs").orderBy(F.desc("weight"), "source", "target").limit(20)
    # (section, number that goes first if larger, texts that go first if lesser, line)
    parts = [
        list_concepts(o, 20).select(F.lit(0).alias("section"), F.col("occurrences").cast("double").alias("big"), F.col("canonical").alias("a"), none.alias("b"), text("- ", F.col("canonical"), " (", F.col("occurrences"), ")").alias("markdown")),
        o.conventions.select(F.lit(1), F.col("frequency").cast("double"), "kind", "value", text("- `", F.col("value"), "` ", F.lower("kind"), ": ", F.col("semantic_role"), " (", F.col("frequency"), ")")),
        o.links("AbbreviationOf").select(F.lit(2), F.lit(0.0), "source", "target", text("- ", F.col("source"), ": ", F.col("target"))),
        top.select(F.lit(3), "pagerank", "name", none, F.rtrim(text("- ", F.col("name"), " (", F.col("kind"), ") ", F.coalesce("semantic_role", none)))),
        co.select(F.lit(4), "weight", "source", "target", text("- ", F.col("source"), " + ", F.col("target"), " (", F.regexp_replace(F.col("weight").cast("string"), r"\.0$", ""), ")")),
    ]
    heads = [(i, float("inf"), "", str(j), x) for i, t in enumerate(("Concepts", "Conventions", "Abbreviations", "Entities", "Co-occurrence")) for j, x in enumerate((*(("# Ontology", "") if not i else ("",)), f"## {t}", ""))]
    out = spark.createDataFrame(heads, "section int, big double, a string, b string, markdown string")
    for p in parts:
        out = out.union(p)
    return out.orderBy("section", F.desc("big"), "a", "b", "markdown").select("markdown")


def write_markdown(o: Ontology, path: str) -> None:
    """The lines of generate_ontology_md as one file; they pass the driver one partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(r.markdown + "\n" for r in generate_ontology_md(o).toLocalIterator())


@tool
def benchmark_embeddings(o: Ontology, threshold: float = 0.30) -> DataFrame:
    """Separation of behaviour clusters at a similarity threshold."""
    from .ontology import _clustered

    labels = _clustered(o.logic_vectors, 1 - threshold)
    return embedding.separation(o.logic_vectors.join(labels, "id"))


@tool
def concept_neighbours(o: Ontology, term: str, top_k: int = 5) -> DataFrame:
    one = resolve_concept(o, term)
    q = o.concept_vectors.join(F.broadcast(one.withColumnRenamed("canonical", "id")), "id", "left_semi")
    return clusters.nearest(q, o.concept_vectors, top_k).select("rank", F.col("id").alias("canonical"), "score").orderBy("rank")
