import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.vectors import cosine

SPLIT = {
    "spatial_transform": "spatial transform", "SpatialTransform": "spatial transform", "ndim": "ndim", "_private_var": "private var", "__init__": "init", "nb_features": "nb features",
    "HTTPSConnection": "https connection", "get_2d_array": "get 2d array", "getFieldValue": "get field value", "x": "x", "": "", "___": "",
}


def test_split_identifier(spark):
    df = spark.createDataFrame([(k,) for k in SPLIT], "name string")
    assert {r.name: " ".join(r.t) for r in df.select("name", T.split_identifier("name").alias("t")).collect()} == SPLIT


@pytest.mark.parametrize(
    ("short", "candidates", "want"),
    [
        ("seg", "segmentation segment value", "segment"), ("trf", "transform transfer", "transfer"), ("tra", "transform trajectory", "transform"), ("xyz", "apple banana", None), ("", "transform", None), ("abc", "ab", None),
        ("lut", "convolution", None), ("vol", "convolution", None), ("non", "convolution", None), ("out", "convolution", None), ("c", "convolution", "convolution"), ("n", "convolution", None),
    ],
)
def test_find_abbreviation(spark, short, candidates, want):
    words = candidates.split()
    assert T.find_abbreviation(short, words) == want
    df = spark.createDataFrame([(short, c) for c in words], "s string, c string").select("c", T.abbreviation_class(F.col("s"), F.col("c")).alias("k")).where("k is not null")
    best = df.orderBy("k", F.length("c")).first()
    assert (best.c if best else None) == want


def test_annotations():
    for text, want in {"Optional[Tensor]": "Tensor", "Union[None, Optional[int]]": "int", " str ": "str", "Union[Dict[str, int], None]": "Dict[str, int]", "Optional[Union[A, B]]": "A"}.items():
        assert T.normalize_annotation(text) == want
    assert T.split_top_level("a, b[c, d], (e, f)") == ["a", "b[c, d]", "(e, f)"]


def test_text_helpers(spark):
    assert T.dedent("    a\n      b\n\n    c") == "a\n  b\n\nc"
    assert T.strip_docstring_quotes('r"""Doc."""') == "Doc."
    assert T.strip_block_comment("/** One\n * two\n */") == "One\ntwo"
    assert T.strip_line_doc("/// a\n/// b") == "a\nb"
    assert T.split_path("a::b::C") == ("a::b", "C")
    df = spark.createDataFrame([(["a/b/c.py", "a/b/d/e.py"],), (["x/y.py"],), (["a/x.py", "b/x.py"],)], "p array<string>")
    assert [r[0] for r in df.select(T.common_directory(F.col("p"))).collect()] == ["a/b", "x", ""]
    row = spark.createDataFrame([("m.f.g", [1.0, 0.0], [0.0, 0.0], [2.0, 0.0])], "s string, a array<double>, z array<double>, b array<double>")
    assert tuple(row.select(T.last_part(F.col("s")), T.scope_root(F.col("s")), cosine(F.col("a"), F.col("z")), cosine(F.col("a"), F.col("b"))).first()) == ("g", "m", 0.0, 1.0)


def test_stop_words():
    assert "yield" in T.stop_words("python") and "fn" not in T.stop_words("python")
    assert {"fn", "yield"} <= T.stop_words("python,rust") and not T.stop_words("cobol")
    assert T.stop_words("typescript") == T.stop_words("javascript")
