"""Entities: code objects promoted to nodes, their edges and roles.

An entity's key is ``name|file|line``; concepts are keyed by their canonical name. Every edge is a row
(source, target, kind, weight).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concept_match, last_part, scope_root, split_identifier
from .conventions import matches
from .graph import SMALL, settled, small


def key(name="name", file="file", line="line"):
    return F.concat_ws("|", F.col(name), F.col(file), F.col(line).cast("string"))


def concept_tags(named: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name, tags): the concepts of each subtoken of distinct names, in the order of the subtokens.

    A subtoken has the concept it equals, else the longest it shares a beginning of 4 bytes with. Matches share
    the first letter, which the join is on.
    """
    names = named.select("name").distinct().select("name", F.posexplode(split_identifier("name")).alias("pos", "t"))
    toks = names.select("t").distinct()
    c = concepts.select("canonical").distinct()
    hits = toks.join(c, F.substring("t", 1, 1) == F.substring("canonical", 1, 1)).withColumn("rank", concept_match(F.col("t"), F.col("canonical"))).where("rank is not null")
    best = hits.groupBy("t").agg(F.min_by("canonical", F.struct("rank", -F.length("canonical"), "canonical")).alias("concept"))
    return names.join(best, "t").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "concept"))), lambda s: s["concept"]).alias("tags"))


def method_signatures(signatures: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, method, file, line, ...): the first signature of each method, by file and line."""
    names = classes.select(F.col("name").alias("class")).distinct()
    s = signatures.where("scope is not null").withColumn("class", scope_root(F.col("scope"))).join(names, "class", "left_semi")
    w = Window.partitionBy("class", "name").orderBy("file", "line")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("class", F.col("name").alias("method"), F.col("file").alias("sig_file"), F.col("line").alias("sig_line"))


def promote(signatures: DataFrame, classes: DataFrame, call_sites: DataFrame | None, concepts: DataFrame) -> DataFrame:
    """(id, name, kind, tags, file, line, class) of what counts as an entity.

    Classes with a concept, a subclass or a call; all methods of these; functions outside classes with a concept or a call.
    Without call sites references are not asked: all classes and their methods, and functions outside classes with a concept.
    """
    methods = classes.select(F.col("name").alias("class"), F.col("file").alias("cf"), F.col("line").alias("cl"), F.explode("methods").alias("name"))
    tags = concept_tags(classes.select("name").unionByName(signatures.select("name")).unionByName(methods.select("name")), concepts)
    kept = classes.join(tags, "name", "left")
    if call_sites is not None:
        called = call_sites.select(last_part(F.col("callee")).alias("name")).distinct().withColumn("called", F.lit(True))
        bases = classes.select(F.explode("bases").alias("b")).select(last_part(F.col("b")).alias("name")).distinct().withColumn("based", F.lit(True))
        kept = kept.join(called, "name", "left").join(bases, "name", "left").where("tags is not null or called or based")
    empty = F.array().cast("array<string>")
    out = [kept.select("name", F.lit("class").alias("kind"), F.coalesce("tags", empty).alias("tags"), "file", "line", F.lit(None).cast("string").alias("class"))]
    sigs = method_signatures(signatures, classes)
    promoted = kept.select(F.col("name").alias("class")).distinct()
    m = methods.join(promoted, "class", "left_semi").join(sigs, (methods["class"] == sigs["class"]) & (methods["name"] == sigs["method"]), "left")
    m = m.select(methods["class"], "name", F.coalesce("sig_file", "cf").alias("file"), F.coalesce("sig_line", "cl").alias("line")).join(tags, "name", "left")
    out.append(m.select("name", F.lit("method").alias("kind"), F.coalesce("tags", empty).alias("tags"), "file", "line", "class"))
    inside = classes.select(F.col("name").alias("root")).distinct()
    f = signatures.withColumn("root", scope_root(F.col("scope"))).join(inside, "root", "left_anti")
    f = f.join(tags, "name") if call_sites is None else f.join(tags, "name", "left").join(called, "name", "left").where("tags is not null or called")
    out.append(f.select("name", F.lit("function").alias("kind"), F.coalesce("tags", empty).alias("tags"), "file", "line", F.lit(None).cast("string").alias("class")))
    return reduce(DataFrame.unionByName, out).select(key().alias("id"), "name", "kind", "tags", "file", "line", "class")


def instantiates(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("source"), F.explode("tags").alias("target"), F.lit("Instantiates").alias("kind"), F.lit(1.0).alias("weight"))


def member_of(entities: DataFrame) -> DataFrame:
    c = entities.where("kind = 'class'").select(F.col("id").alias("target"), F.col("name").alias("class"))
    return entities.where("kind = 'method'").select(F.col("id").alias("source"), "class").join(c, "class").select("source", "target", F.lit("MemberOf").alias("kind"), F.lit(1.0).alias("weight"))


def inherits_from(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """An edge for every pair of entities named as a class and as one of its bases; not made distinct."""
    pairs = classes.select(F.col("name").alias("child"), F.explode("bases").alias("b")).select("child", last_part(F.col("b")).alias("base"))
    a = entities.select(F.col("name").alias("child"), F.col("id").alias("source"))
    b = entities.select(F.col("name").alias("base"), F.col("id").alias("target"))
    return pairs.join(a, "child").join(b, "base").where("source <> target").select("source", "target", F.lit("InheritsFrom").alias("kind"), F.lit(1.0).alias("weight"))


def uses(entities: DataFrame, call_sites: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Distinct caller-callee edges by name; callees in files that the call's file imports are preferred to others.

    imports: (file, resolved_file).
    """
    calls = call_sites.where("caller_scope is not null").select(scope_root(F.col("caller_scope")).alias("caller"), last_part(F.col("callee")).alias("callee"), F.col("file").alias("at"))
    a = entities.select(F.col("name").alias("caller"), F.col("id").alias("source"))
    b = entities.select(F.col("name").alias("callee"), F.col("id").alias("target"), F.col("file").alias("there"))
    if imports is None:
        few = entities.limit(SMALL + 1).count() <= SMALL
        # few entities meet the calls as they are; among many, calls between the same two names are made one first
        named = calls.select("caller", "callee")
        pairs = named.join(F.broadcast(a), "caller").join(F.broadcast(b), "callee") if few else named.distinct().join(a, "caller").join(b, "callee")
    else:
        pairs = calls.distinct().join(a, "caller").join(b, "callee")
        known = imports.where("resolved_file is not null").select(F.col("file").alias("at"), F.col("resolved_file").alias("there")).distinct().withColumn("near", F.lit(1))
        pairs = pairs.join(known, ["at", "there"], "left").na.fill(0, ["near"])
        pairs = pairs.withColumn("best", F.max("near").over(Window.partitionBy("caller", "callee", "at"))).where("near = best")
    return pairs.where("source <> target").select("source", "target").distinct().select("source", "target", F.lit("Uses").alias("kind"), F.lit(1.0).alias("weight"))


def with_roles(entities: DataFrame, classes: DataFrame, conventions: DataFrame) -> DataFrame:
    """Add ``semantic_role``: module classes, else the first convention that fits (most frequent, then by kind and value), else by the last concept."""
    modules = classes.where(F.exists("bases", lambda b: last_part(b) == "Module")).select(F.col("name")).distinct().withColumn("module", F.lit(True))
    names = entities.select("name").distinct()
    conv = small(settled(conventions.select(F.col("kind").alias("ck"), "value", F.col("semantic_role").alias("role"), "frequency")))
    fit = names.join(conv, matches(F.col("name"), F.col("ck"), F.col("value"))).groupBy("name").agg(F.min_by("role", F.struct(-F.col("frequency"), "ck", "value")).alias("role"))
    joined = entities.join(modules, "name", "left").join(fit, "name", "left")
    last = F.element_at("tags", -1)
    some = F.size("tags") > 0
    role = (
        F.when((F.col("kind") == "class") & F.col("module") & some, F.concat(last, F.lit(" module")))
        .when(F.col("role").isNotNull() & some, F.concat("role", F.lit(" ("), F.array_join("tags", ", "), F.lit(")")))
        .when(F.col("role").isNotNull(), F.col("role"))
        .when(some, F.concat_ws(" ", last, "kind"))
        .otherwise(F.lit(""))
    )
    return joined.withColumn("semantic_role", role).select(*entities.columns, "semantic_role")


def entity_calls(entities: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(entity, callee): calls made in an entity's file under its own name, or as ``Class.method`` for methods."""
    c = call_sites.where("caller_scope is not null").select("caller_scope", "file", "callee")
    e = entities.select("id", "file", F.when(F.col("kind") == "method", F.concat_ws(".", "class", "name")).otherwise(F.col("name")).alias("caller_scope"))
    return c.join(e, ["caller_scope", "file"]).select(F.col("id").alias("entity"), "callee")


def density(entities: DataFrame, concept_counts: DataFrame) -> DataFrame:
    """Add ``density``: uses (canonical, total) of the entity's concepts over its number of subtokens."""
    flat = entities.select("id", F.explode("tags").alias("canonical")).join(concept_counts.select("canonical", "total"), "canonical").groupBy("id").agg(F.sum("total").alias("sum"))
    return entities.join(flat, "id", "left").withColumn("density", F.coalesce("sum", F.lit(0)) / F.greatest(F.size(split_identifier("name")), F.lit(1))).drop("sum")


def resolve_imports(imports: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Add ``resolved_file``: the first candidate path of an import that is among files (file)."""
    here = F.regexp_replace(F.col("file"), r"/?[^/]*$", "")
    ext = F.regexp_extract("file", r"\.([^.]+)$", 1)
    under = lambda d, p: F.when(d == "", p).otherwise(F.concat_ws("/", d, p))
    path = F.replace("source_module", F.lit("."), F.lit("/"))
    py = F.array(*[under(d, F.concat(path, F.lit(end))) for d in (here, F.lit(root)) for end in (".py", "/__init__.py")])
    rel = F.regexp_replace(F.col("source_module"), r"^(\./)+", "")
    up = F.length(F.regexp_extract(rel, r"^((?:\.\./)*)", 1)) / 3
    parts = F.filter(F.split(here, "/"), lambda x: x != "")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up.cast("int"), F.lit(0))), "/")
    js_path = under(base, F.regexp_replace(rel, r"^(?:\.\./)+", ""))
    js = F.when(F.startswith("source_module", F.lit(".")), F.array(*[F.concat(js_path, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")])).otherwise(F.array().cast("array<string>"))
    mod = F.replace(F.regexp_replace(F.col("source_module"), r"^(crate|super|self)(::|$)", ""), F.lit("::"), F.lit("/"))
    rs = F.array(*[under(F.lit(root), F.concat(F.lit("src/"), mod, F.lit(e))) for e in (".rs", "/mod.rs")])
    candidates = F.when(ext == "py", py).when(ext.isin("ts", "tsx", "js", "jsx"), js).when(ext == "rs", rs).otherwise(F.array().cast("array<string>"))
    asked = imports.select("file", "source_module").distinct()
    tried = asked.select("file", "source_module", F.posexplode(candidates).alias("n", "path"))
    found = tried.join(files.select(F.col("file").alias("path")).distinct(), "path").groupBy("file", "source_module").agg(F.min_by("path", "n").alias("resolved_file"))
    return imports.join(found, ["file", "source_module"], "left").select(*imports.columns, "resolved_file")
