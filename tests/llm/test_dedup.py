import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import components as C
from lexloom.llm import minhash
from lexloom.llm.common import shared_dir
from lexloom.llm.components import components
from lexloom.llm.exact_dedup import drop_copies, exact_dedup
from lexloom.llm.line_dedup import LineRuns, dedup_lines
from lexloom.llm.minhash import drop_near_duplicates, near_duplicates
from lexloom.llm.words import byte_words, exact_shingles

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """Documents with columns that clash with what operators make."""
    more = [(i, t, "x", 7, None) for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, kept string, n int, id long").repartition(4)


# exact dedup


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub(" ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        x = SPACES.sub(" ", t or "")
        ids = groups[x]
        least = min((j for j in ids if j is not None), default=None)
        out.append((i, least, len(ids), i == least, hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=repr)


def exact_rows():
    r = random.Random(3)
    long = "".join(r.choice("abc ") for _ in range(5000))
    texts = [None, "", " ", "a", "a ", "a\n\t", "é", "é", long, long + "x", long[:-1] + "y", long, long[:1100], long[:1100], "b" * 64, "b" * 65, "b" * 64]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    rows += [(i, f"copy {i % 3} " + "z" * 70) for i in range(200, 260)]
    return rows + [(5, "twice"), (5, "twice"), (6, "twice"), (7, "two texts"), (7, "another text")]


@pytest.mark.parametrize("few", [0, 200_000])
def test_exact_dedup_is_the_brute_force(spark, few):
    rows = exact_rows()
    got = exact_dedup(docs_of(spark, rows), broadcast_ids=few)
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr) == exact_brute(rows)


def test_long_texts_go_through_all_rounds(spark):
    """Texts of up to two million characters that differ first, last, or at a run's border, and a hot group of copies."""
    r = random.Random(8)
    long = "".join(r.choice("abcd ") for _ in range(2_000_000)).replace("  ", "a ")
    rows, i = [], 0
    for n in (64, 65, 319, 320, 321, 1344, 1345, 5440, 21_824, 87_360, 87_361, 349_504, 1_400_000, len(long)):
        for t in (long[:n], long[:n], long[: n - 1] + "X", long[: n - 1] + "Y", "X" + long[1:n]):
            rows.append((i := i + 1, t))
    rows += [(10_000 + j, long[:5000]) for j in range(700)]
    docs = docs_of(spark, rows)
    got = exact_dedup(docs)
    assert sorted((tuple(x) for x in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr) == exact_brute(rows)
    assert sorted(x.doc_id for x in drop_copies(docs).select("doc_id").collect()) == sorted(i for i, _, _, kept, _ in exact_brute(rows) if kept)


@pytest.mark.parametrize("few", [0, 200_000])
def test_drop_copies_of_rows_without_ids(spark, few):
    rows = [(None, "a"), (None, "a"), (None, "b"), (3, "b"), (None, None), (None, ""), (4, "c"), (4, "c"), (4, "d"), (5, "d "), (6, None)]
    out = [(r.doc_id, r.text) for r in drop_copies(docs_of(spark, rows), broadcast_ids=few).collect()]
    assert sorted(out, key=repr) == sorted([(None, "a"), (3, "b"), (4, "c"), (4, "d"), (5, "d "), (6, None)], key=repr)
    assert drop_copies(docs_of(spark, [])).collect() == []


def test_exact_dedup_without_ids_and_rows(spark):
    got = exact_dedup(docs_of(spark, [(None, "a"), (None, "a"), (None, "b"), (3, "b")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 3, 2, False), (3, 3, 2, True)]
    assert exact_dedup(docs_of(spark, [])).collect() == []


def test_drop_copies_keeps_columns(spark):
    docs = docs_of(spark, exact_rows())
    out = drop_copies(docs)
    assert out.columns == docs.columns
    kept = {(i, h) for i, k, _, keep, h in exact_brute(exact_rows()) if keep}
    got = [(r.doc_id, hashlib.sha256(SPACES.sub(" ", r.text or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(got) == sorted(kept)


# line dedup


def key_of(line):
    return line.strip(" \t\n\r\x0b\f").translate({c: c + 32 for c in range(65, 91)})


def lines_brute(rows, least, min_chars):
    found = {}
    for i, t in rows:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            found.setdefault(k, set()).add(i)
    bad = {k for k, ids in found.items() if len(k) >= min_chars and len(ids) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in bad]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    r = random.Random(9)
    common = ["Share this", "  share THIS\t", "É", "ÀÉ", "©", "x", "", " "]
    rows = [(i, "\n".join(r.choice([*common, f"line {r.randint(0, 12)}", f"own {i}"]) for _ in range(r.randint(0, 9)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (3, "share this"), (3, "share this\nline 1")]


@pytest.mark.parametrize(("batches", "fanout", "shipped", "min_chars"), [(1, 3, 400_000, 1), (7, 2, 400_000, 1), (4, 3, 0, 1), (3, 2, 400_000, 2), (2, 2, 400_000, 0), (2, 2, 0, 0)])
def test_line_dedup_is_the_brute_force(spark, batches, fanout, shipped, min_chars):
    rows = line_rows()
    got = dedup_lines(docs_of(spark, rows), min_docs=5, min_chars=min_chars, batches=batches, fanout=fanout, shipped_keys=shipped)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=repr) == lines_brute(rows, 5, min_chars)


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(docs_of(spark, [])).collect() == []
    got = dedup_lines(docs_of(spark, [(None, "a\nb"), (1, None)]), min_docs=1).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_text) for r in got) == [(1, 0, ""), (2, 2, "")]


def test_runs_are_levelled(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(i, 0), (7, 7)], "hi long, lo long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(7, 7)]


def files(spark):
    import glob

    return glob.glob(shared_dir(spark).removeprefix("file:") + "/lexloom-run-*")


def test_runs_are_merged_without_shuffle_or_sort_and_then_deleted(spark):
    before = len(files(spark))
    runs = LineRuns(spark, min_docs=3, fanout=3, buckets=4)
    batch = lambda i: spark.range(2000).select((F.col("id") % 97).alias("hi"), (F.col("id") % 7 * (i + 1)).alias("lo"))
    for i in range(2):
        runs.add(batch(i))
    with runs._sorted_scans():
        plan = runs._unsettled(batch(5).repartition(4, "hi", "lo").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # the batch only
    for i in range(7):
        runs.add(batch(i % 3))
    live = sum(map(len, runs.levels)) + (runs.old is not None)
    assert live <= 7 and len(files(spark)) - before == live
    seen = {}
    for i in [0, 1, *(j % 3 for j in range(7))]:
        for k in [(r.hi, r.lo) for r in batch(i).collect()]:
            seen[k] = seen.get(k, 0) + 1
    assert {tuple(r) for r in runs.frequent().collect()} == {k for k, n in seen.items() if n >= 3}
    runs.drop()
    assert len(files(spark)) == before


def test_lines_of_a_very_long_text(spark):
    """A text of 200,000 lines and one line of two million characters, with rows without an id."""
    long = "\n".join(f"l{i % 70_000}" for i in range(200_000))
    rows = [(1, long), (2, "z" * 2_000_000 + "\nl5"), (3, "Z" * 2_000_000), (None, "l5\nl6"), (None, "l6"), (None, "l6\nl7")]
    for shipped in (400_000, 0):
        got = dedup_lines(docs_of(spark, rows), min_docs=2, shipped_keys=shipped)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=repr) == lines_brute(rows, 2, 1)


# near duplicates


def near_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(exact_shingles(byte_words(t), k))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(exact_shingles(byte_words(t), k)), root(i), root(i) == i) for i, t in rows)


def chained(r, n, words, changes):
    """Texts that each differ a little from the one before."""
    w = [f"w{r.randint(0, 10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(w))
        for _ in range(changes):
            w[r.randrange(len(w))] = f"w{r.randint(0, 10_000)}"
    return out


def near_rows():
    r = random.Random(11)
    texts = [None, "", " \n ", "one", "one two", "One TWO", "one two three", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h\tI"]
    for n, words, changes in ((12, 120, 1), (12, 60, 2), (8, 400, 6), (6, 25, 1), (30, 200, 5)):
        texts += chained(r, n, words, changes)
    texts += [texts[12]] * 5
    rows = list(enumerate(texts, 1))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "stars", "sketch", "block"), [(3, 85, 2, 512, 512), (5, 80, 2, 512, 512), (3, 70, 1, 16, 4)])
def test_near_duplicates_are_the_brute_force(spark, monkeypatch, k, percent, stars, sketch, block):
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "SKETCH", sketch)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LARGE", 16 * block if block > 4 else 6)
    rows = near_rows()
    got = near_duplicates(docs_of(spark, rows), k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == near_brute(rows, k, percent)


def test_a_frame_that_links_nothing_brings_few_together(spark, monkeypatch):
    """Eight hundred texts of 70 % equal words, so that buckets are large and hardly any are linked: what is left over meets by rare
    shingles only. Among them near copies, and one text of 150,000 words with its near copy."""
    r = random.Random(21)
    w = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    frame = w(105)
    texts = [" ".join(frame[:50] + w(22) + frame[50:] + w(23)) for _ in range(800)]
    for i in range(0, 100, 5):
        a = texts[i].split()
        a[r.randrange(len(a))] = "changed"
        texts.append(" ".join(a))
    long = w(150_000)
    texts += [" ".join(long), " ".join([*long[:-100], *w(100)])]
    rows = list(enumerate(texts, 1))
    docs = docs_of(spark, rows).select(F.col("doc_id").alias("id"), "text")
    assert not np.array_equal(minhash.prefix_of(np.arange(100, dtype=np.uint64), np.arange(50, dtype=np.uint64), 85), np.arange(16))
    pending = spark.createDataFrame([(b, i, len(exact_shingles(byte_words(t), 3)), i) for b in (1, 2) for i, t in rows], "bucket long, id long, n long, component long")
    monkeypatch.setattr(minhash, "LARGE", 512)
    cut = minhash.refined(pending, docs, 3, 85)
    groups = [x.n for x in cut.groupBy("bucket").agg(F.countDistinct("id").alias("n")).collect()]
    met = sum(n * (n - 1) // 2 for n in groups)
    assert max(groups) < 50 and met < 20_000  # of 2 * 337,000 pairs
    want = {tuple(sorted((i, j), reverse=True)) for i, j in [(1 + i, 801 + i // 5) for i in range(0, 100, 5)] + [(len(texts) - 1, len(texts))]}
    assert want <= {(x.a, x.b) for x in minhash.left_over(pending, docs, 3, 85).collect()}


def test_a_large_group_of_copies_and_a_chain(spark):
    """Two thousand equal sets (some by other words in between, which make no new shingle), and links through a hub."""
    r = random.Random(5)
    chain = chained(r, 20, 100, 1)
    rows = [(i, "a b c a b c a b c" if i % 2 else "a b c a b c") for i in range(10, 2010)] + [(5000 + i, t) for i, t in enumerate(chain)] + [(5100, "a b c a b")]
    got = near_duplicates(docs_of(spark, rows), 3, 85).collect()
    assert {x.component_id for x in got if x.doc_id < 5000} == {10} and {x.component_id for x in got if 5000 <= x.doc_id < 5100} == {5000}
    assert [x.n_shingles for x in got if x.doc_id in (10, 11, 5100)] == [3, 3, 3] and [x.component_id for x in got if x.doc_id == 5100] == [10]


def test_near_duplicates_of_odd_rows(spark):
    assert near_duplicates(docs_of(spark, [])).collect() == []
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v"), (4, None)]
    got = near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    docs = docs_of(spark, rows)
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "None"]


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(500, 501), (7, 7), (None, 3)], "a long, b long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}
    assert components(edges.where("a < 0")).collect() == []


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_hubs(spark, monkeypatch, few):
    """A hub of 3,000 nodes, one of its nodes a hub itself, dealt over tasks or broadcast."""
    monkeypatch.setattr(C, "BROADCAST_EDGES", few)
    edges = spark.range(1, 3001).select(F.lit(5000).alias("a"), F.col("id").alias("b")).unionByName(spark.range(7000, 8000).select(F.lit(2500).alias("a"), F.col("id").alias("b"))).unionByName(spark.range(9000, 9100).select("id", (F.col("id") + 100).alias("b")).withColumnRenamed("id", "a"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in [*range(1, 3001), 5000, *range(7000, 8000)]} | {i: i for i in range(9000, 9100)} | {i + 100: i for i in range(9000, 9100)}
