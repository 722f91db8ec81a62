"""The registered queries and the pipeline on the test tables."""

import hashlib
import os
import struct
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lexloom.llm.decontaminate import item_words
from lexloom.llm.queries import ORACLES, QUERIES
from lexloom.llm.words import exact_shingles

from ..compare import connect, exists, rows_of, sql_rows
from .test_dedup import SPACES, near_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not exists(SF), reason="no test tables")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_each_operator_has_one_query():
    found = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_the_sqls(spark, name):
    con = connect(SF)
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(con, ORACLES[name])


def test_tokens_are_the_librarys(spark):
    byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for t in (byte, word):
        t.no_padding()
        t.no_truncation()
    texts = [(r["doc_id"], r["text"] or "") for r in rows("documents")]
    n = {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in texts}
    assert {tuple(r)[:4] for r in QUERIES["op1_token_counts"](spark, SF).collect()} == {(i, len(t.encode()), n[i], n[i] > 1024) for i, t in texts}
    want = set()
    for i, t in texts:
        ids = word.encode(t, add_special_tokens=False).ids
        back = word.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op8_bpe_encode_decode"](spark, SF).collect()} == want


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in rows("documents") if r["text"]}
    got = QUERIES["op5_language_id"](spark, SF).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang.get(r.doc_id)]
    assert len(held) > 20 and sum(held) / len(held) >= 0.95
    quality = {r["doc_id"]: r["quality"] for r in rows("labels")}
    got = QUERIES["op9_quality_classifier"](spark, SF).collect()
    held = [r.predicted == quality[r.doc_id] for r in got if r.held_out and r.doc_id in quality]
    assert len(held) > 10 and sum(held) / len(held) >= 0.85


def test_pipeline_is_the_brute_force(spark):
    """Each stage against its definition on what the stage before kept; the last against the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [exact_shingles(item_words(r["text"]), 5) for r in rows("benchmark")]
    least = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "encode":
            word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            word.no_padding()
            word.no_truncation()
            got = {r.doc_id: r for r in out.collect()}
            assert set(got) == set(before)
            for i, t in before.items():
                ids = word.encode(t or "", add_special_tokens=False).ids
                assert got[i].ids == ids and got[i].decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            continue
        assert out.columns == columns
        kept = {r.doc_id for r in out.collect()}
        if name == "language":
            want = {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_copies":
            for i, t in sorted(before.items()):
                least.setdefault(SPACES.sub(" ", t or ""), i)
            want = set(least.values())
        elif name == "near_copies":
            want = {i for i, _, _, keep in near_brute(list(before.items()), 5, 80) if keep}
        else:
            own = {i: exact_shingles(item_words(t), 5) for i, t in before.items()}
            want = {i for i, s in own.items() if not any(100 * len(s & x) >= 80 * len(x) for x in items if x)}
        assert kept == want, name
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run_writes_each_stage(spark, tmp_path):
    last = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(last.columns) and 0 < last.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_rows_are_by_crc(spark):
    got = QUERIES["op5_language_id"](spark, SF).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{root}/lexloom"):
        for n in names:
            if n.endswith(".py") and "/llm" not in folder:
                assert "llm" not in open(f"{folder}/{n}", encoding="utf-8").read(), f"{folder}/{n}"
