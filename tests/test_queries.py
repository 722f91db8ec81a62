import pytest

from lexloom.plans.all_queries import ORACLES, QUERIES

from .compare import connect, exists, rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_the_sqls(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(connect(SF), ORACLES[name])


@pytest.mark.skipif(not exists(SF), reason="no test tables")
def test_tools_hold_their_invariants(spark):
    run = lambda name: QUERIES[f"tool_{name}"](spark, SF).collect()
    listed = run("list_concepts")
    assert [r.occurrences for r in listed] == sorted((r.occurrences for r in listed), reverse=True)
    assert all(r.canonical == r.canonical.lower() for r in listed) and len({r.canonical for r in listed}) == len(listed)
    assert all(0 <= r.confidence <= 1 for r in run("suggest_name")) and len(run("suggest_name")) <= 5
    assert len(run("list_entities")) <= 20
    assert len(run("compact_context")) == 1 and run("compact_context")[0].tokens <= 500
    assert "# Ontology" in run("generate_ontology_md")[0].markdown
    assert [r.place for r in run("trace_concept")] == list(range(len(run("trace_concept"))))
