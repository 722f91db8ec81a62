import os
import re
import subprocess

import pytest

from lexloom.sources import config, store
from lexloom.sources.frontends import braces, parse, parse_text, python, relation
from lexloom.sources.scan import check_root, detect, git_tree, glob_regex, globs, ignored, list_files, scan
from lexloom.streaming.watch import enrich, watch

PY = '''"""Module."""
import os.path as p
from .a.b import x
class Net(nn.Module):
    """A net."""
    def __init__(self, nb_features: int, vol=None):
        self.vol = vol
    @staticmethod
    def warp(trf: torch.Tensor) -> Tensor:
        return ne.warp(trf)
def load(source: Optional[str]) -> Data:
    def inner(): pass
    return go(source)
'''
TS = """import D, { A, B as C } from "./x";
/** A service. */
export class Svc extends Base implements Foo {
  private name: string = "q";
  getUser(id: number): Promise<User> { return this.http.get(id); }
}
export const useThing = (a: number): Foo => { return helper(a); };
interface Foo { a: number; }
type Bar = string;
"""
RS = """use std::{io::{self, Read}, collections::HashMap as Map};
/// A point.
pub struct Point { x: f32 }
impl Shape for Point { fn area(&self, nb: usize) -> f32 { compute(self.x) } }
fn main() { println!("hi"); Point::new(1); }
"""


def test_python():
    r = parse_text(PY, "a.py", "python")
    kinds = {(x["name"], x["entity_type"]) for x in r["identifiers"]}
    assert {("nb_features", "Parameter"), ("vol", "Attribute"), ("warp", "Function"), ("Net", "Class"), ("torch.Tensor", "TypeAnnotation"), ("staticmethod", "Decorator")} <= kinds
    assert not {"self"} & {n for n, _ in kinds}
    (c,) = r["classes"]
    assert (c["bases"], c["methods"], c["attributes"], c["docstring_first_line"]) == (["nn.Module"], ["__init__", "warp"], ["vol"], "A net.")
    assert [(x["caller_scope"], x["callee"]) for x in r["call_sites"]] == [("Net.warp", "ne.warp"), ("load", "go")]
    assert [(x["source_module"], x["imported_symbols"], x["alias"]) for x in r["imports"]] == [("os.path", [], "p"), ("a.b", ["x"], None)]
    assert [(x["name"], x["kind"], x["depth"]) for x in r["nesting"]][1:] == [("Net", "Class", 1), ("__init__", "Method", 2), ("warp", "Method", 2), ("load", "Function", 1), ("inner", "Function", 2)]
    assert {x["text"] for x in r["doc_texts"]} == {"Module.", "A net."}
    assert all(not v for v in parse_text("def broken(:", "b.py", "python").values())


def test_braces():
    r = parse_text(TS, "a.ts", "typescript")
    kinds = {(x["name"], x["entity_type"]) for x in r["identifiers"]}
    assert {("Svc", "Class"), ("Foo", "Interface"), ("Bar", "TypeAlias"), ("name", "Attribute"), ("id", "Parameter"), ("useThing", "Function")} <= kinds
    assert (r["classes"][0]["bases"], r["classes"][0]["methods"]) == (["Base", "Foo"], ["getUser"])
    assert r["imports"][0]["imported_symbols"] == ["D", "A", "B"]
    assert {x["callee"] for x in r["call_sites"]} == {"this.http.get", "helper"}
    r = parse_text(RS, "a.rs", "rust")
    assert (r["classes"][0]["name"], r["classes"][0]["bases"], r["classes"][0]["methods"]) == ("Point", ["Shape"], ["area"])
    assert ("std::collections", ["HashMap"], "Map") in [(x["source_module"], x["imported_symbols"], x["alias"]) for x in r["imports"]]
    assert {x["callee"] for x in r["call_sites"]} == {"compute", "println!", "new"}


@pytest.fixture
def tree(tmp_path):
    for path, text in {"a.py": PY, "pkg/b.py": "def load_data(): pass\n", "pkg/test_c.py": "x = 1\n", "out/d.py": "y = 1\n", "e.ts": TS, ".gitignore": "out/\n"}.items():
        p = tmp_path / "repo" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "repo")


def test_scan_and_store(spark, tree, tmp_path):
    inc, exc = globs(["python", "typescript"])
    assert list_files(tree, inc, exc) == ["a.py", "e.ts", "pkg/b.py"]
    assert ignored("a/b/c.log", ["*.log", "!keep.log"]) and not ignored("keep.log", ["*.log", "!keep.log"])
    rx = glob_regex(["**/test_*", "**/node_modules", "src/?.py"])
    assert [bool(re.match(rx, p)) for p in ("test_a.py", "x/test_d/y.py", "a/node_modules/b/c.js", "src/a.py", "latest_a.py", "src/ab.py")] == [True, True, True, True, False, False]
    assert not re.match(glob_regex([]), "") and not re.match(glob_regex([]), "a")
    files = scan(spark, tree, ["python", "typescript"])
    far = scan(spark, f"file://{tree}", ["python", "typescript"])
    assert sorted(r.file for r in far.collect()) == ["a.py", "e.ts", "out/d.py", "pkg/b.py"]
    assert sorted((r.file, r.language) for r in files.collect()) == [("a.py", "python"), ("e.ts", "typescript"), ("pkg/b.py", "python")]
    assert detect(files).first().language == "python"
    parsed = parse(files)
    sigs = relation(parsed, "signatures")
    assert {"load_data", "warp", "getUser"} <= {r.name for r in sigs.collect()}
    index = str(tmp_path / "index")
    assert store.load(spark, index) is None
    m = store.manifest(files)
    store.save(spark, index, {"signatures": sigs, "manifest": m})
    back = store.load(spark, index)
    assert back["signatures"].count() == sigs.count() and store.is_fresh(back["manifest"], m)
    assert store.load(spark, index, files=files, languages={"python", "typescript"}) is not None and store.load(spark, index, languages={"python"}) is None
    os.makedirs(f"{index}/pointers/000000000009")  # a writer that was lost before its end
    assert store.load(spark, index)["signatures"].count() == sigs.count()
    os.utime(f"{tree}/a.py", (1, 1))
    assert store.load(spark, index, files=scan(spark, tree, ["python", "typescript"])) is None
    now = store.manifest(scan(spark, tree, ["python"]))
    assert {(r.file, r.change) for r in store.changes(back["manifest"], now).collect()} == {("a.py", "modified"), ("e.ts", "removed")}


def test_rust_shapes_with_lifetimes_and_bounds():
    text = """
pub struct Bar<'a, T> { x: &'a T }
impl<T: Fn(u8) -> u8> Foo<T> for Bar<T> {
    pub async fn go<'a>(&'a self, q: Vec<Option<u8>>) -> Result<&'a str, Err> where T: Clone { let c = 'x'; helper::<Vec<u8>>(c, '\\'', '"'); call(q) }
}
fn plain<F>(f: F) -> impl Fn(u8) -> u8 where F: Fn(&str) -> bool { if a < b && c > d { other(1) } f }
"""
    out = braces.parse(text, "a.rs", "rust")
    sigs = {s["name"]: s for s in out["signatures"]}
    assert set(sigs) == {"go", "plain"} and sigs["go"]["scope"] == "Bar" and [p["name"] for p in sigs["go"]["params"]] == ["q"] and sigs["go"]["params"][0]["type_annotation"] == "Vec<Option<u8>>"
    bar = {c["name"]: c for c in out["classes"]}["Bar"]
    assert bar["bases"] == ["Foo"] and bar["methods"] == ["go"]
    assert [(c["callee"], c["caller_scope"]) for c in out["call_sites"]] == [("helper", "Bar.go"), ("call", "Bar.go"), ("other", "plain")]


def test_generic_arrow_functions():
    text = """
const f = async <T,>(a: T): Promise<Map<string, T>> => { use(a); };
const g = <T extends Record<string, () => void>>(a: T, b: Array<Array<T>>) => a;
const h: Fn<number> = (x) => x;
export class Box<T extends (a: number) => string> extends Base<T> { run<U>(u: U): void { call<U>(u); } }
const less = a < b;
"""
    out = braces.parse(text, "a.ts", "typescript")
    sigs = {s["name"]: s for s in out["signatures"]}
    assert set(sigs) == {"f", "g", "h", "run"} and [p["name"] for p in sigs["g"]["params"]] == ["a", "b"] and sigs["run"]["scope"] == "Box"
    assert out["classes"][0]["bases"] == ["Base"] and out["classes"][0]["methods"] == ["run"]
    assert [c["callee"] for c in out["call_sites"]] == ["use", "call"]


def test_python_with_errors_is_read_in_part():
    text = "import os\n\ndef one(a):\n    print 'old', a\n    return two(a)\n\nclass C:\n    def m(self):\n        exec 'x' in {}\n        if a <> b:\n            call(1)\n\ndef last(b): return b\n"
    out = python.parse(text, "a.py")
    assert [s["name"] for s in out["signatures"]] == ["one", "m", "last"] and [c["name"] for c in out["classes"]] == ["C"]
    assert {c["callee"] for c in out["call_sites"]} == {"two", "call"} and out["imports"][0]["source_module"] == "os"
    assert [s["name"] for s in python.parse("def good(): pass\n\ndef bad(:\n    \"\"\"never closed\n", "b.py")["signatures"]] == ["good"]
    assert parse_text("\x00", "c.py", "python")["signatures"] == [] and python.parse("", "d.py")["signatures"] == []


def test_detection(spark):
    of = lambda *names: tuple(detect(spark.createDataFrame([(n,) for n in names], "file string")).first())
    assert of() == ("python", 0)
    assert of("a.rs", "b.rs", "c.py") == ("rust", 3) and of("a.rs", "b.ts") == ("typescript", 2)
    assert of("a.ts", "b.js") == ("python", 2) and of("a.mjs") == ("javascript", 1)
    assert of("node_modules/a.js", ".x/b.js", ".c.js", "a/b/c/d.js", "a/b/c.py") == ("python", 1)


def test_git_tree(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", tree, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    assert sorted(r.file for r in git_tree(spark, tree, "HEAD", ["python"]).collect()) == ["a.py", "pkg/b.py", "pkg/test_c.py"]
    with pytest.raises(ValueError):
        git_tree(spark, tree, "nowhere", ["python"])
    assert check_root(tree) == os.path.realpath(tree)
    with pytest.raises(ValueError):
        check_root("/tmp")


def test_config_and_packs(spark, tmp_path):
    assert config.load_config(str(tmp_path / "none.toml")).params.threshold == 0.3
    (tmp_path / "c.toml").write_text("[analysis]\nmin_frequency = 0\ntfidf_threshold = 0.5\n")
    c = config.load_config(str(tmp_path / "c.toml"))
    assert c.params.min_frequency == 1 and c.params.threshold == 0.5
    (tmp_path / "bad.yaml").write_text("version: 99\n")
    with pytest.raises(ValueError, match="unsupported"):
        config.load_pack(str(tmp_path / "bad.yaml"))
    assert config.load_packs(["bad.yaml", "missing.yaml"], str(tmp_path)) == []
    rows = spark.createDataFrame([("abbreviation", "trf", "transform", 1), ("term", "transform", "3", 1), ("convention", "nb_", "count", 1), ("association", "fixed", "moving", 1)], "section string, name string, detail string, rank int")
    path = str(tmp_path / "pack.yaml")
    config.dump_pack(rows, path)
    pack = config.load_pack(path)
    assert pack["abbreviations"] == [{"short": "trf", "long": "transform"}]
    concepts = spark.createDataFrame([("fixed",), ("moving",)], "canonical string")
    conv = spark.createDataFrame([], "kind string, value string, entity_type string, semantic_role string, examples array<string>, frequency bigint")
    edges = spark.createDataFrame([], "source string, target string, kind string, weight double")
    cs, cv, es = config.merge_pack(spark, concepts, conv, edges, pack)
    assert {r.canonical for r in cs.collect()} == {"fixed", "moving", "transform", "trf"}
    assert [r.value for r in cv.collect()] == ["nb_"] and {(r.source, r.kind) for r in es.collect()} == {("trf", "AbbreviationOf"), ("fixed", "Contrastive")}
    assert config.to_json(rows.limit(1)).startswith("[\n")
    assert config.merge_enrichment(es, spark.createDataFrame([("a", "b")], "source string, target string")).count() == 3


def test_watch_replaces_changed_files(spark, tree, tmp_path):
    index, cp = str(tmp_path / "index"), str(tmp_path / "cp")
    run = lambda: watch(spark, tree, index, cp, once=True).awaitTermination(120)
    run()
    names = lambda: {r.name for r in store.load(spark, index)["signatures"].collect()}
    assert {"load_data", "warp"} <= names()
    (open(f"{tree}/pkg/f.py", "w")).write("def fresh(): pass\n")
    run()
    assert {"load_data", "warp", "fresh"} <= names()
    os.remove(f"{tree}/pkg/f.py")
    (open(f"{tree}/pkg/g.py", "w")).write("def later(): pass\n")
    run()
    assert "later" in names() and "fresh" not in names() and "load_data" in names()
    with pytest.raises(ValueError):
        watch(spark, tree, f"{tree}/index", cp)


def test_enrichment_resumes(spark, tmp_path):
    texts = spark.createDataFrame([(f"t{i}", f"text {i}") for i in range(5)], "id string, text string")
    path = str(tmp_path / "vectors")
    asked = iter([True, False])
    assert enrich(spark, texts, path, batch=2, wanted=lambda: next(asked)).count() == 2
    assert enrich(spark, texts, path, batch=2).count() == 5
