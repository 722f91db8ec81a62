"""Tools that SQL does not express, against brute force on small ontologies that are given relation by relation."""

import random

import numpy as np
import pytest

from lexloom.operators.embedding import HashingEmbedder
from lexloom.plans import tools
from lexloom.plans.ontology import Ontology, relations_of

WORDS = [f"{a}{b}" for a in ("transform", "space", "grid", "path", "vol", "count") for b in ("", "er", "ing", "s", "map", "list")]


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(7)
    occ = [(w, f"{w}_{r.choice(WORDS)}", "Function", f"f{r.randrange(4)}.py", i) for i, w in enumerate(r.choices(WORDS, k=300))]
    occ += [(w, f"{w}_own", "Class", "g.py", 1) for w in WORDS]
    conv = [("Prefix", f"p{i}_", "Parameter", f"role {i % 7}", [f"p{i}_x"], 3 + i % 40) for i in range(1500)]
    ents = [(f"e{i}", f"{r.choice(WORDS)}_{i}", r.choice(["function", "method", "class"]), r.sample(WORDS, r.randrange(0, 4)), r.choice(["", "count", "transform module"]), f"d{i % 3}/f{i % 5}.py", i) for i in range(80)]
    edges = [(a, b, "CoOccurs", float(r.randrange(1, 9)) / 2) for a in WORDS for b in r.sample(WORDS, 3) if a < b]
    edges += [(f"s{i}", f"short{i}", "AbbreviationOf", 1.0) for i in range(1200)] + [("path", "space", "Contrastive", 1.0), ("vol", "volmap", "AbbreviationOf", 1.0)]
    embed = HashingEmbedder()
    df = spark.createDataFrame
    vec = lambda pairs: df([(i, [float(x) for x in v]) for i, v in pairs], "id string, vector array<double>")
    concepts, bodies = embed.embed(WORDS), embed.embed([f"{e[1]} body of {' '.join(e[3])}" for e in ents])
    o = Ontology(
        relations_of(spark), df([(w,) for w in WORDS], "canonical string"), df(occ, "canonical string, identifier string, entity_type string, file string, line long"),
        df(conv, "kind string, value string, entity_type string, semantic_role string, examples array<string>, frequency long"),
        df(ents, "id string, name string, kind string, tags array<string>, semantic_role string, file string, line long"), df(edges, "source string, target string, kind string, weight double"),
        df([(e[0], i % 5, i % 3, 1 / (i + 1)) for i, e in enumerate(ents)], "id string, in_degree long, out_degree long, pagerank double"),
        vec(zip(WORDS, concepts, strict=True)), df([(w, w[:3]) for w in WORDS], "id string, label string"), vec(zip([e[0] for e in ents], bodies, strict=True)), df([(e[0], e[2], "call") for e in ents], "id string, label string, behaviour string"),
    )
    o.data = {"occ": occ, "conv": conv, "ents": ents, "edges": edges, "concepts": dict(zip(WORDS, np.array(concepts), strict=True)), "bodies": dict(zip([e[0] for e in ents], np.array(bodies), strict=True))}
    return o


def cos(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1))


def test_concept_neighbours(small):
    v = small.data["concepts"]
    want = sorted((-round(cos(v["grid"], x), 9), k) for k, x in v.items() if k != "grid")[:7]
    got = tools.call("concept_neighbours", small, term="grid", top_k=7).collect()
    assert [(r.rank, r.canonical) for r in got] == [(i, k) for i, (_, k) in enumerate(want, 1)]
    assert [r.score for r in got] == pytest.approx([-s for s, _ in want]) and tools.call("concept_neighbours", small, term="qqqq").count() == 0


def test_find_similar_logic(small):
    v, name = small.data["bodies"], {e[0]: (e[1], e[5]) for e in small.data["ents"]}
    got = tools.call("find_similar_logic", small, name=name["e3"][0].upper(), top_k=9).collect()
    want = sorted((-round(cos(v["e3"], x), 9), k) for k, x in v.items() if k != "e3")[:9]
    assert [(r.name, r.file) for r in got] == [name[k] for _, k in want] and tools.call("find_similar_logic", small, name="nobody").count() == 0


def test_generate_ontology_md_has_all(small, tmp_path):
    """All conventions and abbreviations, 1,500 and 1,201 of them, in order; the first 20 of the rest."""
    d = small.data
    uses = {w: sum(o[0] == w for o in d["occ"]) for w in WORDS}
    lines = ["# Ontology", "", "## Concepts", "", *[f"- {w} ({n})" for n, w in sorted(((n, w) for w, n in uses.items()), key=lambda x: (-x[0], x[1]))[:20]]]
    lines += ["", "## Conventions", "", *[f"- `{c[1]}` prefix: {c[3]} ({c[5]})" for c in sorted(d["conv"], key=lambda c: (-c[5], c[0], c[1]))]]
    lines += ["", "## Abbreviations", "", *[f"- {a}: {b}" for a, b, k, _ in sorted(d["edges"]) if k == "AbbreviationOf"]]
    lines += ["", "## Entities", "", *[f"- {e[1]} ({e[2]}) {e[4]}".rstrip() for e in d["ents"][:20]]]
    lines += ["", "## Co-occurrence", "", *[f"- {a} + {b} ({w:g})" for w, a, b in sorted(((w, a, b) for a, b, k, w in d["edges"] if k == "CoOccurs"), key=lambda x: (-x[0], *x[1:]))[:20]]]
    tools.write_markdown(small, str(tmp_path / "o.md"))
    assert (tmp_path / "o.md").read_text().splitlines() == lines and len(lines) > 2700


def test_compact_context_counts_all_rows(spark, small):
    """A file of 900 functions: sections are halved from their true sizes, beyond 200 rows too."""
    names = sorted(f"fn{i}" for i in range(900))
    sigs = spark.createDataFrame([(n, "big.py", i) for i, n in enumerate(names)], "name string, file string, line long").selectExpr("name", "cast(array() AS array<struct<name: string, type_annotation: string, default: string>>) AS params", "cast(null AS string) AS return_type", "file", "line", "cast(null AS string) AS scope")
    o = Ontology({**small.relations, "signatures": sigs}, *(getattr(small, k) for k in ("concepts", "occurrences", "conventions", "entities", "edges", "centrality")))
    for budget in (100, 500, 10_000):
        keep = 900
        body = lambda k: "## Structure\n" + "\n".join(f"- function {n}" for n in names[:k]) if k else ""
        while len(body(keep)) / 4 > budget and keep:
            keep //= 2
        got = tools.call("compact_context", o, scope="big.py", max_tokens=budget).first()
        assert got.text == body(keep) and got.tokens == len(body(keep)) // 4 and (keep > 200) == (budget > 500)


def test_list_entities_and_query_concept(small):
    d = small.data
    got = tools.call("list_entities", small, concept="path", role="COUNT", kind="function", top_k=100).collect()
    want = {e[1] for e in d["ents"] if "path" in e[3] and "count" in e[4] and e[2] == "function"}
    assert {r.name for r in got} == want
    uses = {w: sum(o[0] == w for o in d["occ"]) for w in WORDS}
    dense = {e[1]: sum(uses[t] for t in e[3]) / max(1, len(e[1].split("_"))) for e in d["ents"]}
    every = tools.call("list_entities", small, top_k=100).collect()
    assert len(every) == 80 and all(r.density == pytest.approx(dense[r.name]) for r in every)
    rows = tools.call("query_concept", small, term="path", max_variants=1000, max_occurrences=1000, max_related=1000, max_entities=1000).collect()
    of = lambda s: [r.name for r in rows if r.section == s]
    assert of("variant") == sorted({o[1] for o in d["occ"] if o[0] == "path" or "path" in o[1]})
    assert of("occurrence") == [o[1] for o in sorted((o for o in d["occ"] if o[0] == "path"), key=lambda o: (o[3], o[4], o[1]))]
    assert sorted(of("related")) == sorted([b for a, b, *_ in d["edges"] if a == "path"] + [a for a, b, *_ in d["edges"] if b == "path"]) and of("related")[0] == "space"
    assert of("entity") == [e[1] for e in sorted((e for e in d["ents"] if "path" in e[3]), key=lambda e: (e[1], e[5], e[6]))]


def test_export_domain_pack_and_logic(small):
    d = small.data
    rows = tools.call("export_domain_pack", small).collect()
    of = lambda s: [(r.rank, r.name, r.detail) for r in sorted(rows, key=lambda r: r.rank) if r.section == s]
    assert of("abbreviation") == [(i, a, b) for i, (a, b) in enumerate(sorted((a, b) for a, b, k, _ in d["edges"] if k == "AbbreviationOf")[:30], 1)]
    assert of("convention") == [(i, c[1], c[3]) for i, c in enumerate(sorted(d["conv"], key=lambda c: (-c[5], c[0], c[1]))[:30], 1)]
    assert of("association") == [(1, "path", "space")] and len(of("term")) == len(WORDS)
    groups = {k: sorted(w for w in WORDS if w[:3] == k) for k in {w[:3] for w in WORDS}}
    assert of("cluster") == [(i, k, ", ".join(groups[k][:8])) for i, k in enumerate(sorted(k for k in groups if len(groups[k]) > 1), 1)]
    e = d["ents"][4]
    got = tools.call("describe_logic", small, name=e[1]).first()
    assert (got.cluster, got.behaviour, got.in_degree, got.out_degree, got.pagerank) == (e[2], "call", 4, 1, 1 / 5) and got.members == sorted({x[1] for x in d["ents"] if x[2] == e[2]})
