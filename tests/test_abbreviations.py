import random

from lexloom.plans.all_queries import QUERIES


def test_abbreviations_of_all_words(spark, tmp_path):
    """Rare words too: the pairs are below rank 300 of the words, and are all that brute force finds."""
    r = random.Random(4)
    rare = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(150)} | {"cfg", "configuration", "x", "xy", "xylo", "stringbuilder", "sb"})
    often = [f"{'q' * (i // 26 + 1)}{chr(97 + i % 26)}" for i in range(310)]
    docs = [(0, " ".join(often * 2), "s"), (1, " ".join(rare), "s"), (2, None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    words = sorted(set(rare + often))
    kind = lambda a, b: None if len(a) >= len(b) else 0 if b.startswith(a) else 1 if len(a) > 1 and a[0] == b[0] and 3 * len(a) >= len(b) and all(c in it for it in [iter(b)] for c in a) else None
    pairs = {(a, b): k for a in words for b in words if (k := kind(a, b)) is not None}
    edges = [(e.source, e.target) for e in QUERIES["abbreviation_edges"](spark, str(tmp_path)).collect()]
    assert sorted(edges) == sorted(p for p in pairs if len(p[0]) >= 3) and len(pairs) > 500 and ("cfg", "configuration") not in pairs
    best = {a: min((k, len(b), b) for (x, b), k in pairs.items() if x == a) for a in {a for a, _ in pairs}}
    assert {r.short: (r["class"], len(r.expansion), r.expansion) for r in QUERIES["find_abbreviation"](spark, str(tmp_path)).collect()} == best
