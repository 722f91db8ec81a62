import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import abbreviation_class
from lexloom.operators import abbreviations as A
from lexloom.operators import graph as G


def brute(a, b):
    a, b = a.lower(), b.lower()
    if not 0 < len(a) < len(b):
        return None
    it = iter(b)
    return 0 if b.startswith(a) else 1 if len(a) > 1 and a[0] == b[0] and 3 * len(a) >= len(b) and all(x in it for x in a) else None


@pytest.mark.parametrize("longs", [7, 4000])
def test_no_pair_is_left_out(spark, monkeypatch, longs):
    """Words of few letters, so that most hold many others; upper case and letters beyond the first plane too."""
    r = random.Random(8)
    words = sorted({"".join(r.choice("abcé𝒳B") for _ in range(r.randint(1, 8))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in [*words, *words, "", None]], "canonical string")
    want = {(a, b): k for a in words for b in words if (k := brute(a, b)) is not None}
    monkeypatch.setattr(A.pairs, "__defaults__", (1, False, longs))
    rows = [(x.short, x.long, x["class"]) for x in G.abbreviation_pairs(df).collect()]
    assert {(a, b): k for a, b, k in rows} == want and len(rows) == len(want) > 2000
    of = df.where("canonical <> ''").distinct()
    native = of.select(F.col("canonical").alias("a")).crossJoin(of.select(F.col("canonical").alias("b"))).select("a", "b", abbreviation_class(F.col("a"), F.col("b")).alias("k")).where("k is not null")
    assert {(x.a, x.b): x.k for x in native.collect()} == want
    assert {(x.source, x.target) for x in G.abbreviation_edges(df).collect()} == {p for p in want if len(p[0]) >= 3}
    best = {a: min((k, len(b), b) for (x, b), k in want.items() if x == a) for a in {a for a, _ in want}}
    assert {x.short: (x["class"], len(x.expansion), x.expansion) for x in G.best_expansion(df).collect()} == best
