from lexloom.plans import tools
from lexloom.plans.ontology import Params, build, relations_of

PARAM = "array<struct<name:string,type_annotation:string,default:string>>"


def test_a_tool_makes_the_parts_it_reads(spark):
    sigs = spark.createDataFrame([("load_grid", [("path", "Path", None)], "Optional[Grid]", "t.py", 1, None)], f"name string, params {PARAM}, return_type string, file string, line long, scope string")
    ids = spark.createDataFrame([(f"{a}_{b}", "Function", f"{a}.py", 1, None) for a in ("load", "save", "load") for b in ("grid", "mask", "path")], "name string, entity_type string, file string, line long, scope string")
    calls = spark.createDataFrame([("load_grid", "load_grid", "t.py", 5)] * 3, "caller_scope string, callee string, file string, line long")
    o = build(relations_of(spark, signatures=sigs, identifiers=ids, call_sites=calls), Params(threshold=0.1))
    made = lambda: {k for k in vars(o) if k not in ("relations", "params", "configured", "embedder", "_made")} | set(o._made)
    tools.call("list_conventions", o).collect()
    assert made() == {"conventions"}
    assert {(r.type, r.flows) for r in tools.call("type_flows", o).collect()} == {("Grid", 3), ("Path", 3)} and made() == {"conventions"}
    assert [(r.type, r.kind) for r in tools.call("trace_type", o, type_name="grid").collect()] == [("Grid", "return")] * 3 and made() == {"conventions"}
    assert tools.call("concept_neighbours", o, term="load").count() == 0 or "concept_vectors" in made()
    assert not made() & {"entities", "centrality", "logic_vectors", "Uses"}
    tools.call("describe_symbol", o, name="load_grid").collect()
    assert made() >= {"entities", "Uses", "InheritsFrom", "MemberOf"} and not made() & {"centrality", "logic_vectors", "CoOccurs", "SimilarTo"}
    assert set(r.kind for r in o.edges.select("kind").distinct().collect()) <= {"CoOccurs", "AbbreviationOf", "Contrastive", "Instantiates", "SimilarTo", "Uses"}
