"""Settings from TOML, domain packs from YAML, results as JSON."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conventions import merge_conventions
from ..plans.ontology import Params

PACK_VERSION = 1


@dataclass
class Config:
    languages: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    conventions: list[dict] = field(default_factory=list)
    packs: list[str] = field(default_factory=list)
    min_files: int = 5
    batch: int = 64
    health: tuple[float, float, float] = (0.33, 0.33, 0.33)
    params: Params = field(default_factory=Params)


def load_config(path: str) -> Config:
    """Settings of a TOML file, defaults where it or a key is absent. Counts are at least 1."""
    p = Path(path)
    raw = tomllib.loads(p.read_text()) if p.is_file() else {}
    index, analysis, logic, embed, health = (raw.get(k, {}) for k in ("index", "analysis", "logic", "embeddings", "health"))
    c = Config(languages=index.get("languages", []), include=index.get("include", []), exclude=index.get("exclude", []), conventions=raw.get("conventions", []), packs=raw.get("domain_packs", []))
    c.min_files, c.batch = max(1, int(index.get("min_files", 5))), max(1, int(embed.get("batch_size", 64)))
    c.health = tuple(float(health.get(k, 0.33)) for k in ("coverage", "consistency", "cohesion"))
    d = Params()
    c.params = Params(
        languages=",".join(c.languages), min_frequency=max(1, int(analysis.get("min_frequency", d.min_frequency))), threshold=float(analysis.get("tfidf_threshold", d.threshold)),
        convention_threshold=max(1, int(analysis.get("convention_threshold", d.convention_threshold))), concept_similarity=float(embed.get("similarity_threshold", d.concept_similarity)), logic_similarity=float(logic.get("similarity_threshold", d.logic_similarity)),
    )
    return c


def load_pack(path: str) -> dict:
    pack = yaml.safe_load(Path(path).read_text())
    if not isinstance(pack, dict) or pack.get("version") != PACK_VERSION:
        raise ValueError(f"unsupported domain pack version in {path}")
    return pack


def load_packs(paths: list[str], root: str) -> list[dict]:
    """Packs by paths relative to root; those that cannot be read are reported and left out."""
    out = []
    for p in paths:
        try:
            out.append(load_pack(str(Path(root, p))))
        except (OSError, ValueError, yaml.YAMLError) as e:
            print(f"domain pack {p} is left out: {e}")
    return out


def dump_pack(rows: DataFrame, path: str | None = None) -> str:
    """The rows of export_domain_pack as YAML; a pack has at most 210 rows."""
    got = rows.orderBy("section", "rank").collect()
    of = lambda s: [r for r in got if r.section == s]
    pack = {
        "version": PACK_VERSION,
        "abbreviations": [{"short": r.name, "long": r.detail} for r in of("abbreviation")],
        "conventions": [{"pattern": r.name, "role": r.detail} for r in of("convention")],
        "terms": [{"name": r.name, "frequency": int(r.detail)} for r in of("term")],
        "associations": [{"kind": "contrastive", "names": [r.name, r.detail]} for r in of("association")] + [{"kind": "similar", "names": r.detail.split(", ")} for r in of("cluster")],
    }
    text = yaml.safe_dump(pack, sort_keys=False)
    if path:
        Path(path).write_text(text)
    return text


def merge_pack(spark: SparkSession, concepts: DataFrame, conventions: DataFrame, edges: DataFrame, pack: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts (canonical, ...), conventions and edges with what the pack adds; what is known stays as it is."""
    shape = lambda p: "Suffix" if p.startswith("_") and not p.endswith("_") else "Conversion" if p.startswith("_") else "Prefix"
    words = dict.fromkeys([t["name"] for t in pack.get("terms", [])] + [x for a in pack.get("abbreviations", []) for x in (a["short"], a["long"])])
    new = spark.createDataFrame([(w.lower(),) for w in words], "canonical string").join(concepts.select("canonical"), "canonical", "left_anti")
    concepts = concepts.unionByName(new, allowMissingColumns=True)
    given = spark.createDataFrame([(shape(c["pattern"]), c["pattern"], c.get("entity_type", "Variable"), c["role"]) for c in pack.get("conventions", [])], "kind string, value string, entity_type string, semantic_role string")
    pairs = [("AbbreviationOf", a["short"], a["long"], 1.0) for a in pack.get("abbreviations", [])]
    for a in pack.get("associations", []):
        kind, weight = ("Contrastive", 1.0) if a["kind"] == "contrastive" else ("SimilarTo", 0.8)
        pairs += [(kind, x, y, weight) for i, x in enumerate(a["names"]) for y in a["names"][i + 1 :]]
    more = spark.createDataFrame(pairs, "kind string, source string, target string, weight double").join(concepts.select(F.col("canonical").alias("source")), "source", "left_semi").join(concepts.select(F.col("canonical").alias("target")), "target", "left_semi")
    both = edges.select("source", "target", "kind").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind"))
    edges = edges.unionByName(more.join(both, ["source", "target", "kind"], "left_anti").select(*edges.columns))
    return concepts, merge_conventions(conventions, given), edges


def to_json(df: DataFrame, budget: int = 40_000) -> str:
    """Rows as pretty JSON, compact when that is over the budget of bytes. For results that a reader sees."""
    rows = [json.loads(x) for x in df.toJSON().collect()]
    pretty = json.dumps(rows, indent=2, ensure_ascii=False)
    return pretty if len(pretty.encode()) <= budget else json.dumps(rows, separators=(",", ":"), ensure_ascii=False)


def merge_enrichment(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges of a type checker (source, target) added as InheritsFrom where they are new."""
    new = found.join(edges.where("kind = 'InheritsFrom'").select("source", "target"), ["source", "target"], "left_anti").select("source", "target", F.lit("InheritsFrom").alias("kind"), F.lit(1.0).alias("weight"))
    return edges.unionByName(new.select(*edges.columns))
