import random

import numpy as np

from lexloom.llm import language_id as L

from .test_models import language_docs, language_rows


def test_a_large_model_keeps_its_order(spark):
    """Beyond ``part_ngrams`` the order stays, and parts predict what the whole model does."""
    docs = language_docs(spark, language_rows())
    own = docs.select("doc_id", "text", "lang")
    whole, parts = L.train(own), L.train(own, part_ngrams=100)
    assert whole.order == parts.order == L.ORDER and parts.langs == whole.langs and len(parts.parts) > 5 and not isinstance(whole, L.Sharded)
    assert parts.calibration == whole.calibration
    texts = [t or "" for _, t, _ in language_rows()] + ["漢字 ka", "zz qq"]
    assert np.array_equal(whole.entropies(texts)[0], parts.entropies(texts)[0])
    rows = lambda model: sorted(map(repr, L.identify(own, model).collect()))
    assert rows(whole) == rows(parts)


def test_the_default_never_lowers_the_order(spark):
    docs = language_docs(spark, language_rows()).select("doc_id", "text", "lang")
    before = {r.doc_id: tuple(r) for r in L.language_id(docs).collect()}
    after = {r.doc_id: tuple(r) for r in L.language_id(docs, part_ngrams=200).collect()}
    assert before == after


def test_over_two_million_ngrams_keep_the_order(spark):
    """At the default bound: the model is in parts of order ORDER, and still tells what it was taught."""
    r = random.Random(3)
    low = {"aa": 0x4E00, "bb": 0x6E00}
    rows = [(i, "".join(chr(low[x] + r.randrange(6000)) for _ in range(9_000)), x) for i, x in enumerate(["aa", "bb"] * 170)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.train(own)
    assert isinstance(model, L.Sharded) and model.order == L.ORDER and len(model.parts) > 1
    asked = spark.createDataFrame([(i, t[:300], None) for i, t, _ in rows[:10]], "doc_id long, text string, lang string")
    assert {x.doc_id: x.lang_pred for x in L.identify(asked, model).collect()} == {i: x for i, _, x in rows[:10]}
