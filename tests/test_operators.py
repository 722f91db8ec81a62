import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import clusters as K
from lexloom.operators import embedding as E
from lexloom.operators import entities as N
from lexloom.operators import graph as G
from lexloom.operators import vocabulary as V
from lexloom.operators.conventions import conventions
from lexloom.plans import tools
from lexloom.plans.ontology import Params, build, relations_of

OCC = [(1, "transform", x) for x in ("spatial_transform", "apply_transform", "transform")] + [(2, "spatial", "spatial_transform")] + [(3, "ndim", "ndim")] * 3
OCC += [(4, "nb", x) for x in ("nb_features", "nb_bins", "nb_steps", "nb_dims")] + [(5, "features", x) for x in ("nb_features", "features")]


def five(spark, occ=OCC, conv=True):
    o = spark.createDataFrame([(c, i) for _, c, i in occ], "canonical string, identifier string")
    rows = [("Prefix", "nb_", "Parameter", "count", ["nb_bins"], 4)] if conv else []
    return o.select("canonical").distinct(), o, spark.createDataFrame(rows, "kind string, value string, entity_type string, semantic_role string, examples array<string>, frequency long")


def verdicts(spark, names, *given):
    asked = spark.createDataFrame([(n,) for n in names], "input string")
    return {r.input: r for r in tools.check_names(asked, *given).collect()}


def test_naming_verdicts(spark):
    got = verdicts(spark, ["nb_features", "n_dims", "xyzzy_foo"], *five(spark))
    assert (got["n_dims"].verdict, got["n_dims"].suggestion, got["n_dims"].confidence) == ("Inconsistent", "nb_dims", 0.8)
    assert (got["xyzzy_foo"].verdict, got["xyzzy_foo"].confidence) == ("Unknown", 0.0)
    assert got["nb_features"].convention == "nb_" and got["nb_features"].confidence == 0.8
    got = verdicts(spark, ["ndim"], *five(spark, [(1, "ndim", "ndim")] * 3, False))
    assert (got["ndim"].verdict, got["ndim"].confidence) == ("Consistent", 0.6)
    got = verdicts(spark, ["spatial_trf"], *five(spark, [(1, "spatial", "spatial_transform")] * 8 + [(1, "spatial", "spatial_trf")], False))
    assert got["spatial_trf"].verdict == "Inconsistent" and got["spatial_trf"].confidence == pytest.approx((1 - 1 / 8) * np.log2(9) / 4, abs=1e-6)


def labels(spark, rows, threshold):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, vector array<double>")
    return {r.id: r.label for r in K.cluster(df, threshold).collect()}


def test_average_linkage(spark):
    assert labels(spark, [], 0.25) == {}
    four = labels(spark, [(1, [1.0, 0, 0]), (2, [0.0, 1, 0]), (3, [0.0, 0, 1]), (4, [-1.0, 0, 0])], 0.25)
    assert len(set(four.values())) == 4
    assert labels(spark, [(1, [1.0, 0, 0]), (2, [0.95, 0.05, 0]), (3, [0.0, 1, 0]), (4, [0.05, 0.95, 0])], 0.25) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert len(set(labels(spark, [(1, [1.0, 0, 0]), (2, [0.95, 0.3122, 0]), (3, [0.3, 0, 0.954])], 0.5).values())) == 2
    assert labels(spark, [(1, [1.0, 0]), (2, None), (3, [1.0, 0.01])], 0.25) == {1: 1, 2: 2, 3: 1}
    assert set(labels(spark, [(i, [1.0, 0, 0]) for i in range(3)], 0.5).values()) == {0}


def rank(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "id long")
    e = spark.createDataFrame(edges, "source long, target long")
    return {r.id: r for r in G.pagerank(n, e, iterations=40).collect()}


def test_pagerank(spark):
    assert rank(spark, [], []) == {}
    assert rank(spark, [1], [])[1].pagerank == pytest.approx(1.0)
    r = rank(spark, [1, 2, 3], [(1, 2), (2, 3)])
    assert r[3].pagerank > r[1].pagerank and sum(x.pagerank for x in r.values()) == pytest.approx(1.0)
    r = rank(spark, [1, 2, 3, 4], [(1, 4), (2, 4), (3, 4), (1, 9)])
    assert max(r.values(), key=lambda x: x.pagerank).id == 4 and r[4].in_degree == 3
    r = rank(spark, [1, 2, 3], [(1, 2), (2, 3), (3, 1)])
    assert max(x.pagerank for x in r.values()) - min(x.pagerank for x in r.values()) < 0.01


def test_cross_reference(spark):
    a = spark.createDataFrame([(i, 0) for i in (1, 2, 3)] + [(i, 1) for i in (4, 5)], "id long, a long")
    b = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)], "id long, b long")
    assert {(r.a, r.b): round(r.jaccard, 4) for r in K.cross_reference(a, b, 0.5).collect()} == {(0, 0): 0.6667, (1, 1): 0.6667}


def test_topological_order():
    assert G.topological_order(["c", "a", "b"], [("a", "b"), ("b", "c")]) == ["a", "b", "c"]
    assert sorted(G.topological_order(["a", "b", "c"], [("a", "b"), ("b", "a"), ("c", "a")])) == ["a", "b", "c"]


def test_reach_and_diff(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "source long, target long")
    assert {r.id: r.depth for r in G.reach(spark.createDataFrame([(1,)], "id long"), e, 2).collect()} == {1: 0, 2: 1, 3: 2}
    base = spark.createDataFrame([("transform", 2, ["spatial_transform"])], "canonical string, n long, names array<string>")
    head = spark.createDataFrame([("transform", 2, ["spatial_transform"]), ("displacement", 1, ["compute_displacement"])], base.schema)
    assert [(r.change, r.canonical) for r in tools.diff_states(base, head).collect()] == [("added", "displacement")]


def test_conventions_and_contrast(spark):
    ids = spark.createDataFrame([(f"nb_{x}", "Parameter") for x in "abcd"] + [("a_to_b", "Function")] * 3 + [("IFoo", "Interface"), ("IBar", "Interface"), ("IBaz", "Interface"), ("x$", "Variable")], "name string, entity_type string")
    got = {(r.kind, r.value): r for r in conventions(ids).collect()}
    assert got["Prefix", "nb_"].semantic_role == "count" and got["Prefix", "nb_"].frequency == 4
    assert got["Conversion", "_to_"].frequency == 3 and got["Prefix", "I"].semantic_role == "interface" and ("Suffix", "$") not in got
    words = spark.createDataFrame([("source",), ("target",), ("vol",), ("trf",)], "canonical string")
    lists = spark.createDataFrame([(i, n) for i in range(4) for n in ("vol", "trf")], "list_id long, name string")
    assert [(r.source, r.target) for r in G.contrastive_edges(words, lists, G.abbreviation_edges(words)).collect()] == [("source", "target")]


def test_co_occurrence_counts_rows_and_scopes(spark):
    rows = [("a_b", "F", "f", 1, "s"), ("a_b", "F", "f", 2, "s"), ("b_c", "F", "f", 3, None), ("a_a_b_b", "F", "g", 1, "t")]
    ids = spark.createDataFrame(rows, "name string, entity_type string, file string, line long, scope string")
    kept = spark.createDataFrame([("a",), ("b",), ("c",)], "canonical string")
    assert {(r.a, r.b): r.weight for r in V.co_occurrence(V.subtokens(ids), kept).collect()} == {("a", "b"): 2 + 1 + 0.5 + 0.5, ("b", "c"): 1}


def test_entities_prefer_imported_files(spark):
    ents = spark.createDataFrame([("f|a|1", "f", "a"), ("g|b|1", "g", "b"), ("g|c|1", "g", "c")], "id string, name string, file string")
    calls = spark.createDataFrame([("f", "m.g", "a", 2)], "caller_scope string, callee string, file string, line long")
    imports = spark.createDataFrame([("a", "c")], "file string, resolved_file string")
    assert [r.target for r in N.uses(ents, calls, imports).collect()] == ["g|c|1"]
    assert {r.target for r in N.uses(ents, calls).collect()} == {"g|b|1", "g|c|1"}


def test_import_resolution(spark):
    imports = spark.createDataFrame([("pkg/a.py", "b"), ("pkg/a.py", "lib.c"), ("web/x.ts", "../util/y"), ("web/x.ts", "react"), ("src/m.rs", "crate::n::o")], "file string, source_module string")
    files = spark.createDataFrame([(x,) for x in ("pkg/b/__init__.py", "lib/c.py", "util/y/index.ts", "src/n/o.rs")], "file string")
    got = {r.source_module: r.resolved_file for r in N.resolve_imports(imports, files).collect()}
    assert got == {"b": "pkg/b/__init__.py", "lib.c": "lib/c.py", "../util/y": "util/y/index.ts", "react": None, "crate::n::o": "src/n/o.rs"}


def test_embedder_and_flows(spark):
    v = E.HashingEmbedder().embed(["transform", "transforms", "zebra", ""])
    assert v[0] @ v[1] > 0.6 > v[0] @ v[2] and not v[3].any()
    assert np.allclose(np.linalg.norm(E.mean_pool(np.ones((2, 3, 4)), np.ones((2, 3))), axis=1), 1)
    assert np.allclose(E.first_pool(np.ones((2, 3, 4))), 0.5) and E.is_stale(1, 2)
    param = "array<struct<name:string,type_annotation:string,default:string>>"
    sigs = spark.createDataFrame([("transform", [("image", "Tensor", None)], "Tensor", "ops.py", 1), ("warp", [("field", "Tensor", None)], "Tensor", "warp.py", 1)], f"name string, params {param}, return_type string, file string, line long")
    calls = spark.createDataFrame([("warp", "transform", "warp.py", 3)], "caller_scope string, callee string, file string, line long")
    assert sorted((r.source, r.target, r.type) for r in tools.flows(sigs, calls).collect()) == [("transform", "warp", "Tensor"), ("warp", "transform", "Tensor")]


def test_subconcepts_split_a_concept(spark):
    names = {"p": ["load_mask_x", "load_mask_y", "load_mask_z"], "q": ["draw_mask_u", "draw_mask_v", "draw_mask_w"]}
    occ = spark.createDataFrame([("mask", n, f) for k, x in names.items() for n in x for f in (k + "1", k + "2", k + "3")], "canonical string, identifier string, file string")
    none = spark.createDataFrame([], "identifier string, t string")
    assert {r.qualifier: r.identifiers for r in G.subconcepts(occ, none).collect()} == {"load": names["p"], "draw": names["q"]}


def test_trace_on_an_ontology(spark):
    param = "array<struct<name:string,type_annotation:string,default:string>>"
    sigs = spark.createDataFrame(
        [("load_data", [], "Data", [], None, "t.py", 1, None), ("apply_transform", [("data", "Data", None)], "Transform", [], None, "t.py", 2, None), ("save_result", [("trf", "Transform", None)], None, [], None, "t.py", 3, None)],
        f"name string, params {param}, return_type string, decorators array<string>, docstring_first_line string, file string, line long, scope string",
    )
    calls = spark.createDataFrame([("load_data", "apply_transform", "t.py", 5), ("apply_transform", "save_result", "t.py", 15)], "caller_scope string, callee string, file string, line long")
    ids = spark.createDataFrame([(n, "Function", "t.py", i, None) for i, n in enumerate(["apply_transform", "transform_data", "load_data", "save_result", "save_data"])], "name string, entity_type string, file string, line long, scope string")
    o = build(relations_of(spark, signatures=sigs, call_sites=calls, identifiers=ids), Params(threshold=0.1))
    got = {r.name: (r.place, r.role) for r in tools.trace_concept(o, "transform").collect()}
    assert got["apply_transform"][1] == "Producer" and got["load_data"][0] < got["apply_transform"][0] < got["save_result"][0]
    assert tools.call("find_similar_logic", o, name="nobody").collect() == []
    with pytest.raises(KeyError):
        tools.call("nothing", o)
    assert o.edges.where(F.col("kind") == "Uses").count() == 2


def greedy_linkage(d, threshold):
    """The closest two clusters merge, by mean distances, one pair at a time."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        m, i, j = min((np.mean([d[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if not m < threshold:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("tile", [7, 2048])
def test_average_linkage_is_the_greedy_one(spark, tile):
    r = np.random.default_rng(5)
    heads = r.normal(size=(6, 8))
    v = np.concatenate([h + r.normal(size=(9, 8)) * s for h, s in zip(heads, (0.1, 0.3, 0.5, 0.7, 0.9, 1.2), strict=True)])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    for threshold in (0.1, 0.35, 0.62, 0.9):
        got = {}
        for row in K.cluster(df, threshold, tile).collect():
            got.setdefault(row.label, set()).add(row.id)
        assert {frozenset(x) for x in got.values()} == greedy_linkage(1 - u @ u.T, threshold) and all(k == min(x) for k, x in got.items())


def test_average_linkage_of_more_than_twenty_thousand():
    """One component of 21,000 vectors, in memory that grows with its rows; no distances are held."""
    r = np.random.default_rng(6)
    heads = np.eye(16)[r.integers(0, 16, 21_000)] + 0.5
    v = heads + r.normal(size=heads.shape) * 0.01
    label = K.average_linkage(v / np.linalg.norm(v, axis=1)[:, None], 0.05)
    assert len(set(label)) == 16 == len({(int(a), int(b)) for a, b in zip(label, heads.argmax(1), strict=True)})


@pytest.mark.parametrize("few", [0, 200_000])
def test_values_flow_along_links(spark, few):
    """A hub of 3,000 edges and a target of as many; edges in buckets by source and piece are not shuffled again."""
    rows = [(0, i, 1 / 3000) for i in range(1, 3001)] + [(i, 0, 0.5) for i in range(1, 3001)] + [(i, i + 1, 0.5) for i in range(1, 3000)]
    links = G.Links(spark.createDataFrame(rows, "source long, target long, share double"), small_rows=few, bucket_rows=4000)
    values = G.settled(spark.range(3001).select("id", (F.col("id") % 7 + 1.0).alias("value")))
    want = {}
    for a, b, s in rows:
        want[b] = want.get(b, 0) + (a % 7 + 1) * s
    flow = links.flow(values)
    assert {r.id: round(r.value, 9) for r in flow.collect()} == {k: round(x, 9) for k, x in want.items()}
    if not few:
        before = flow._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
        assert before.count("Exchange hashpartitioning(source") == 1 and "Bucketed: true" in before
    links.drop()


@pytest.mark.parametrize("few", [0, 200_000])
def test_pagerank_is_the_recursion(spark, monkeypatch, few):
    monkeypatch.setattr(G.Links.__init__, "__defaults__", (few, 1000))
    r = random.Random(3)
    nodes = list(range(400))
    edges = [(r.randrange(400), min(r.randrange(400), r.randrange(400))) for _ in range(2500)] + [(7, i) for i in range(300)] + [(500, 3), (3, 500), (1, 2), (1, 2)]
    live = [(a, b) for a, b in edges if a < 400 and b < 400]
    out = {n: sum(a == n for a, _ in live) for n in nodes}
    p = dict.fromkeys(nodes, 1 / 400)
    for _ in range(40):
        lost = sum(p[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, 0.15 / 400 + 0.85 * lost / 400)
        for a, b in live:
            new[b] += 0.85 * p[a] / out[a]
        p = new
    got = {x.id: x for x in G.pagerank(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "source long, target long"), iterations=40, epsilon=None).collect()}
    assert all(got[n].pagerank == pytest.approx(p[n], abs=1e-12) and got[n].out_degree == out[n] and got[n].in_degree == sum(b == n for _, b in live) for n in nodes)


@pytest.mark.parametrize("in_row", [300, 1])
def test_scopes_of_one_name_are_one(spark, in_row):
    """Two files have a scope of the same name: what one has half of and the other half meets once; a concept pair in both counts once."""
    ids = [("a_x", "v", "f", 1, "run"), ("b_y", "v", "g", 2, "run"), ("a_z", "v", "g", 3, "run"), ("a_b", "v", "f", 4, None), ("c", "v", "f", 5, "go"), ("a", "v", "g", 6, "go")]
    t = V.subtokens(spark.createDataFrame(ids, "name string, entity_type string, file string, line long, scope string"))
    kept = spark.createDataFrame([(x,) for x in "abcxy"], "canonical string")
    got = {(r.a, r.b): r.weight for r in V.co_occurrence(t, kept, in_row=in_row).collect()}
    assert got == {("a", "x"): 1.5, ("b", "y"): 1.5, ("a", "b"): 1.5, ("a", "y"): 0.5, ("b", "x"): 0.5, ("x", "y"): 0.5, ("a", "c"): 0.5}
    apart = {(r.a, r.b): r.weight for r in V.co_occurrence(t, kept, by_file=True, in_row=in_row).collect()}
    assert apart == {("a", "x"): 1.5, ("b", "y"): 1.5, ("a", "b"): 1.5, ("a", "y"): 0.5}
