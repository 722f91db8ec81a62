import random

import pytest

import pyarrow as pa

from lexloom.llm.decontaminate import Items, _pairs, contaminated, drop_contaminated, item_words, least_hits, sketch_size
from lexloom.llm.words import exact_shingles


def tables(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 6, 9, 20, 40, 80])] + [(20, None), (21, ""), (22, "..."), (None, text(9)), (1, "other words of the same item id"), (30, "Ünïcode Wörter, ganz KLEIN geschrieben!")]
    docs = [(i, text(300)) for i in range(10)]
    for n, (_, t) in enumerate(items):
        if t:
            w = t.split()
            docs.append((100 + n, f"{text(500)} {t.upper()} {text(500)}"))
            docs.append((200 + n, f"{text(50)} {', '.join(w[: max(1, len(w) * 9 // 10)])} {text(50)}"))
            docs.append((300 + n, f"{text(50)} {' '.join(w[: len(w) // 2])} {text(50)}"))
            docs.append((400 + n, t))
    docs += [(900, None), (901, ""), (None, items[5][1]), (902, items[6][1]), (902, items[6][1])]
    r.shuffle(docs)
    given = lambda rows, i: spark.createDataFrame([(a, b, "x", 1) for a, b in rows], f"{i} long, text string, n_item string, number int").repartition(3)
    return docs, items, given(docs, "doc_id"), given(items, "item_id")


def brute(docs, items, k, percent):
    out = []
    for d, t in docs:
        own = exact_shingles(item_words(t), k)
        for i, x in items:
            s = exact_shingles(item_words(x), k)
            if i is not None and s and 100 * len(s & own) >= percent * len(s):
                out.append((d, i, len(s & own), len(s)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "percent", "shipped"), [(5, 80, 1 << 25), (5, 80, -1), (3, 50, 1 << 25), (3, 100, -1)])
def test_containment_is_the_brute_force(spark, k, percent, shipped):
    docs, items, d, i = tables(spark)
    got = contaminated(d, i, k, percent, shipped)
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()), key=repr) == brute(docs, items, k, percent)
    assert all(abs(r.containment - r.n_shared / r.n_item) < 1e-12 for r in got.collect())


def test_clean_documents_stay(spark):
    docs, items, d, i = tables(spark)
    out = drop_contaminated(d, i)
    bad = {x[0] for x in brute(docs, items, 5, 80)} - {None}
    assert out.columns == d.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(x) for x, _ in docs if x not in bad)


def test_empty_tables(spark):
    _, _, d, i = tables(spark)
    for shipped in (1 << 25, -1):
        assert contaminated(d.limit(0), i, shipped_bytes=shipped).collect() == []
        assert contaminated(d, i.limit(0), shipped_bytes=shipped).collect() == []


def test_sketches_cannot_be_missed():
    for percent in (50, 80, 99, 100):
        for n in range(1, 200):
            lacking = (100 - percent) * n // 100  # of an item that is just contained
            assert min(n, lacking + 1) <= sketch_size(n, percent) <= n
        assert 1 <= min(least_hits(n, percent) for percent in (50, 80, 99, 100) for n in range(1, 200))


CASED = ["ΟΔΟΣ ΤΗΣ ΠΟΛΗΣ ΜΑΣ ΕΙΝΑΙΣ ΑΥΤΟΣ ΛΟΓΟΣ", "İlk İyi İnce İki İpek İsim İzin", "Straße GROẞE Maße süß heiß weiß", "ǅ ǈ ǋ ǲ ᾈ ᾘ ᾨ Ω K Å", "\U00010400\U00010428 Ꙁ ა Ა Ⴀ ⴀ Ꭰ ꭰ", "日本 語 の 文 章 です ね", "é É e\u0301 E\u0301 ﬁ Ⅷ ⅷ"]


@pytest.mark.parametrize("shipped", [1 << 25, -1])
def test_casing_is_alike_on_both_sides(spark, shipped):
    """Identical texts, and ones whose every character has been lower- or upper-cased alone, on both ways."""
    items = list(enumerate(CASED)) + [(100 + i, t.swapcase()) for i, t in enumerate(CASED)]
    fill = " ".join(f"w{i}" for i in range(400))
    docs = [(i, t) for i, t in items] + [(1000 + i, f"{fill} {t} {fill}") for i, t in items] + [(2000 + i, f"{fill} {''.join(c.lower() for c in t)} {fill}") for i, t in items]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shipped_bytes=shipped).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got), key=repr) == brute(docs, items, 5, 80)
    assert {(i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in got}


def test_many_items_with_a_common_passage_in_a_long_text(spark):
    """One passage begins all items and stands in every document; a document of half a million words."""
    r = random.Random(9)
    vocab = [f"u{i}" for i in range(5000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    common = text(30)
    items = [(i, f"{common} {text(r.choice([2, 5, 9, 40]))}") for i in range(60)]
    docs = [(i, f"{text(40)} {common} {text(40)}") for i in range(300)] + [(1000, f"{text(250_000)} {items[7][1]} {text(250_000)}")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5, 80)
    assert len(want) > 1000 and any(x[0] == 1000 for x in want)
    for shipped in (1 << 25, -1):
        assert sorted(((x.doc_id, x.item_id, x.n_shared, x.n_item) for x in contaminated(d, i, shipped_bytes=shipped).collect()), key=repr) == want


def test_a_worker_holds_the_largest_shipped_benchmark():
    """Items of SHIPPED_BYTES in arrays: what is pickled, and so held by a worker, is far below 300 MB."""
    import pickle

    r = random.Random(2)
    vocab = [f"{r.getrandbits(30):x}" for _ in range(20_000)]
    items = [(i, " ".join(r.choices(vocab, k=120))) for i in range(34_000)]
    assert sum(len(t) for _, t in items) > 31 << 20
    made = Items(items, 5, 80)
    assert len(pickle.dumps(made)) < 150 << 20
    part = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([f"x y z {items[17][1]} q", "none of them at all is here"])], ["doc_id", "text"])
    assert [x.to_pylist() for x in _pairs(iter([part]), made)][0] == [{"doc_id": 1, "item_id": 17, "n_shared": 116, "n_item": 116, "containment": 1.0}]
