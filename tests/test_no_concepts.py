import pytest

from lexloom.plans.all_queries import ORACLES, QUERIES

from .compare import connect, rows_of, sql_rows

NAMES = "promote_entities module_map domain_density entity_edges entity_roles uses_edges vocabulary_health tool_concept_map tool_describe_symbol".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every file has every word, as large tables come to have, so that no word is a concept."""
    d = tmp_path_factory.mktemp("words")
    kinds, names = ["SMALL", "PROMO", "LARGE"], [f"{a} {b}" for a in ("hot", "old") for b in ("anvil", "bolt", "gear")]
    parts = [(n, name, f"Brand#{brand}", kind, size, 1.0) for n, (brand, size, kind, name) in enumerate((b, s, k, x) for b in (1, 2) for s in (3, 4) for k in kinds for x in names)]
    lines = [(i // 4, i * 7 % len(parts), i % 5, i % 4) for i in range(300)]
    docs = [(i, f"the hot gear number {i}\nand so on", "en", "web", 9) for i in range(5)]
    for name, rows, schema in (
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_the_sqls_without_concepts(spark, folder, name):
    assert rows_of(QUERIES[name](spark, folder)) == sql_rows(connect(folder), ORACLES[name])


def test_health_of_no_concepts(spark, folder):
    got = QUERIES["tool_vocabulary_health"](spark, folder).first()
    assert (got.coverage, got.consistency, got.cohesion) == (0.0, 1.0, 1.0) and got.health == pytest.approx(2 / 3)
