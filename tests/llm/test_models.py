import math
import random
import zlib

import numpy as np
import pytest

from lexloom.llm import language_id as L
from lexloom.llm import quality as Q

SYLLABLES = {"aa": "ka lo mi tu ne ra", "bb": "schu ten ger ich ver lich", "cc": "eau oir que ment tion les"}


def text_of(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))


def language_rows():
    r = random.Random(2)
    rows = [(i, text_of(r, lang := r.choice(sorted(SYLLABLES)), r.randint(3, 60)), lang) for i in range(400)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? ---", "bb"), (1003, "漢字仮名交じり文の例", None), (1004, rows[0][1], None), (None, rows[1][1], rows[1][2]), (1005, "\x00\x01 ka lo", None), (1006, "ka lo mi " * 30_000, None)]
    return rows + odd + [rows[3], rows[3]]


def language_docs(spark, rows):
    return spark.createDataFrame([(*x, "s", 0.5) for x in rows], "doc_id long, text string, lang string, source string, score double").repartition(3)


def brute_probability(rows, order, char_floor):
    """Interpolated Kneser-Ney by its textbook recursion, for one language; counts by dict."""
    counts = {order: {}}
    for t in rows:
        padded = "\x01" * (L.ORDER - 1) + t
        for e in range(L.ORDER - 1, len(padded)):
            g = padded[e - order + 1 : e + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for o in range(order - 1, 0, -1):
        counts[o] = {}
        for g in counts[o + 1]:
            counts[o][g[1:]] = counts[o].get(g[1:], 0) + 1

    def p(g):
        o = len(g)
        if o == 0:
            return math.exp(char_floor)
        ones, twos = (sum(v == k for v in counts[o].values()) for k in (1, 2))
        cut = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        own = {x: v for x, v in counts[o].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        lower = p(g[1:])
        return lower if not total else max(own.get(g, 0) - cut, 0) / total + cut * len(own) / total * lower

    return p


def test_probabilities_are_the_textbooks():
    r = random.Random(1)
    texts = [text_of(r, "aa", 12) for _ in range(6)]
    packed = {}
    for t in texts:
        chars, first, _ = L.letters([t])
        for e in np.flatnonzero(L._predicted(first, len(chars))):
            g = tuple(chars[e - L.ORDER + 1 : e + 1].tolist())
            packed[g] = packed.get(g, 0) + 1
    model = L.Model({"aa": (np.array(list(packed), np.uint32), np.array(list(packed.values())))}, L.ORDER)
    want = brute_probability(texts, L.ORDER, float(model.floor))
    for t in [texts[0], "kalomi xyz tu", "zz"]:
        chars, first, _ = L.letters([t])
        at = np.flatnonzero(L._predicted(first, len(chars)))
        got = model.scores(chars, at)[:, 0]
        padded = "\x01" * (L.ORDER - 1) + t
        assert got == pytest.approx([math.log(want(padded[e - L.ORDER + 1 : e + 1])) for e in range(L.ORDER - 1, len(padded))], abs=1e-3)


def test_languages_are_told_apart(spark):
    rows = language_rows()
    got = {}
    for r in L.language_id(language_docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    right = [got[i][0].lang_pred == lang for i, _, lang in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 60 and np.mean(right) > 0.97
    assert all(x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, xs in got.items() for x in xs)
    assert [(got[i][0].lang_pred, got[i][0].score, got[i][0].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[1003][0].rejected and got[1003][0].lang_pred in SYLLABLES and not got[1004][0].rejected
    assert got[1004][0].lang_pred == rows[0][2] and len({tuple(x) for x in got[rows[3][0]]}) == 1
    assert got[1006][0].lang_pred == "aa" and all(0 <= x.score <= 1 for xs in got.values() for x in xs)


def test_choice_and_rejection_are_the_brute_force(spark):
    """Entropies by the textbook recursion for each language, the least one chosen, and rejected by the calibrated limits."""
    r = random.Random(6)
    rows = [(i, text_of(r, lang, 6), lang) for i, lang in enumerate(sorted(SYLLABLES) * 8)]
    asked = ["kalomi tu", "schuten ger", "eauoir", "zz qq xx", "ka schu eau", "mi", "漢字 ka"]
    docs = language_docs(spark, rows + [(1000 + i, t, None) for i, t in enumerate(asked)])
    own = docs.select("doc_id", "text", "lang")
    model = L.train(own)
    fit = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    p = [brute_probability([t for t, x in fit if x == lang], L.ORDER, float(model.floor)) for lang in model.langs]
    got = {x.doc_id: x for x in L.identify(own, model).collect()}
    for i, t in [(1000 + i, t) for i, t in enumerate(asked)] + [(i, t) for i, t, _ in rows[:4]]:
        padded = "\x01" * (L.ORDER - 1) + t
        entropy = [-np.mean([math.log(q(padded[e - L.ORDER + 1 : e + 1])) for e in range(L.ORDER - 1, len(padded))]) for q in p]
        best = int(np.argmin(entropy))
        z = np.exp(-(np.array(entropy) - min(entropy)) / model.calibration["temperature"])
        score = z[best] / z.sum()
        assert got[i].lang_pred == model.langs[best] and got[i].cross_entropy == pytest.approx(entropy[best], abs=1e-3)
        assert got[i].score == pytest.approx(score, abs=0.02)
        assert got[i].rejected == (entropy[best] > model.calibration["limits"][best] or score < L.LEAST)


def test_marks_alone_are_no_letters(spark):
    texts = ["\u0301", "\u0300\u0301 123", "\u0903\u20dd", "a\u0301", "\u0301 ka"]
    docs = language_docs(spark, language_rows() + [(2000 + i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.lang_pred for r in L.language_id(docs).collect()}
    assert [got[2000 + i] == "und" for i in range(5)] == [True, True, True, False, False]


def test_identification_without_labels(spark):
    docs = language_docs(spark, [(1, "ka lo", None), (2, None, None)])
    assert [(r.lang_pred, r.rejected) for r in L.language_id(docs).collect()] == [("und", True)] * 2
    assert L.language_id(docs.limit(0)).collect() == []
    assert L.drop_unidentified(docs).columns == docs.columns and L.drop_unidentified(docs).count() == 0


# quality


def quality_rows():
    r = random.Random(6)
    good = lambda: ". ".join(" ".join(r.choice("the people of that town went over hills and saw rivers".split()) for _ in range(9)).capitalize() for _ in range(r.randint(2, 6)))
    bad = lambda: " ".join(r.choice(["BUY NOW!!!", "$$$ 100%", "click click click", "###", "WIN 9999 $$$"]) for _ in range(r.randint(5, 30)))
    rows, labels = [], []
    for i in range(600):
        y = r.random() < 0.6
        rows.append((i, good() if y else bad()))
        if i % 10:
            labels.append((i, int(y), None))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    odd = [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "word " * 200_000), rows[5], rows[5]]
    docs = spark.createDataFrame([(*x, 3, 0.1) for x in rows + odd], "doc_id long, text string, y int, score double").repartition(3)
    given = spark.createDataFrame([*labels, (2, 7, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality(docs, given).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [(r.predicted == truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean(held) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    same = [r.score for r in got if r.doc_id in (1000, 1001)]
    assert same[0] == same[1] and len({r.score for r in got if r.doc_id == rows[5][0]}) == 1


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality(docs, none).collect()} == {0.5}
    assert Q.quality(docs.limit(0), none).collect() == []


def test_held_out_labels_are_not_used(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels]
    a, b = (sorted(tuple(r) for r in Q.quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_word_vectors_are_sums_of_neighbours():
    raw, at = np.frombuffer(b"a b a", np.uint8), np.array([0, 5])
    word, _, first = Q.tokens(raw, at)
    place, add = (np.concatenate(x) for x in Q._neighbours(word, first))
    table = np.bincount(place, add, Q.ROWS * (Q.DIM + 1)).reshape(Q.ROWS, Q.DIM + 1)
    index = np.zeros((Q.ROWS, Q.DIM))
    for k in range(Q.NONZERO):
        np.add.at(index, (np.arange(Q.ROWS), Q._AT[:, k]), Q._SIGN[:, k])
    a, b = word[0], word[1]
    assert table[a, Q.DIM] == 2 and table[b, Q.DIM] == 1
    assert (table[b, : Q.DIM] == 2 * index[a]).all() and (table[a, : Q.DIM] == 2 * index[b] + 2 * index[a]).all()
