import corpus_pipeline
from lexloom.llm import language_id as L

from .test_models import language_docs, language_rows


def test_language_is_judged_by_row(spark):
    """Good rows stay beside rejected ones of the same id, or of none."""
    rows = language_rows() + [(None, "123", None), (5, "!!", "aa"), (1002, language_rows()[4][1], None)]
    docs = language_docs(spark, rows)
    kept = L.drop_unidentified(docs)
    have = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert kept.columns == docs.columns
    assert ("None", rows[405][1]) in have and ("5", rows[5][1]) in have and ("1002", rows[4][1]) in have
    assert ("None", "123") not in have and ("5", "!!") not in have and ("1002", "123 !? ---") not in have


def test_leaks_are_judged_by_row(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak, clean = f"before {item} after", "nothing of that kind is in this text at all"
    docs = spark.createDataFrame([(1, leak, "a"), (1, clean, "b"), (None, leak, "c"), (None, clean, "d"), (2, None, "e"), (3, leak, "f")], "doc_id long, text string, source string")
    out = corpus_pipeline.leaks(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.source for r in out.collect()) == ["b", "d", "e"]
