"""The ontology: relations to concepts, conventions, edges, entities, ranks. Lazy until a relation is asked for."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import concept_text
from ..operators import clusters, conventions, embedding, entities, graph, vocabulary
from ..schemas import RELATIONS


EDGES = ("CoOccurs", "AbbreviationOf", "Contrastive", "Instantiates", "MemberOf", "InheritsFrom", "Uses", "SimilarTo")


@dataclass
class Params:
    languages: str = ""
    min_frequency: int = 2
    threshold: float = 0.3
    convention_threshold: int = 3
    concept_similarity: float = 0.75
    logic_similarity: float = 0.50
    overlap: float = 0.1
    embed: bool = True
    #: Whether a call or a subclass makes an entity; else all classes and functions with a concept are.
    references: bool = True


@dataclass
class Ontology:
    relations: dict[str, DataFrame]
    concepts: DataFrame
    occurrences: DataFrame
    conventions: DataFrame
    entities: DataFrame
    edges: DataFrame
    centrality: DataFrame
    concept_vectors: DataFrame | None = None
    concept_clusters: DataFrame | None = None
    logic_vectors: DataFrame | None = None
    logic_clusters: DataFrame | None = None
    overlaps: DataFrame | None = None
    doc_context: DataFrame | None = None
    embedder: embedding.Embedder = field(default_factory=embedding.HashingEmbedder)

    def __getattr__(self, name: str) -> DataFrame:
        relations = self.__dict__.get("relations", {})
        if name in relations:
            return relations[name]
        raise AttributeError(name)

    def links(self, *kinds: str) -> DataFrame:
        """The edges of some kinds."""
        return self.edges.where(F.col("kind").isin(*kinds))


def relations_of(spark: SparkSession, **given: DataFrame) -> dict[str, DataFrame]:
    """All relations, those not given empty."""
    return {k: given[k] if k in given else spark.createDataFrame([], "_ " + v).select("_.*") for k, v in RELATIONS.items()} | {k: v for k, v in given.items() if k not in RELATIONS}


class Built(Ontology):
    """An ontology analysed from relations. A part is made when it is first asked for and, if others read it too, written once
    to the shared folder; a tool makes the parts that it reads and no others."""

    def __init__(self, relations: dict[str, DataFrame], params: Params, configured: DataFrame | None = None):
        self.relations, self.params, self.configured = relations, params, configured
        self.embedder = embedding.HashingEmbedder()
        self._made: dict[str, DataFrame] = {}

    @cached_property
    def tokens(self) -> DataFrame:
        return vocabulary.subtokens(self.relations["identifiers"], self.params.languages)

    @cached_property
    def concepts(self) -> DataFrame:
        return graph.settled(vocabulary.concepts(self.relations["identifiers"], self.params.languages, self.params.min_frequency, self.params.threshold))

    @cached_property
    def occurrences(self) -> DataFrame:
        return graph.settled(vocabulary.occurrences(self.tokens, self.concepts))

    @cached_property
    def conventions(self) -> DataFrame:
        found = conventions.conventions(self.relations["identifiers"], self.params.convention_threshold)
        return graph.settled(found if self.configured is None else conventions.merge_conventions(found, self.configured))

    @cached_property
    def entities(self) -> DataFrame:
        r = self.relations
        promoted = entities.promote(r["signatures"], r["classes"], r["call_sites"] if self.params.references else None, self.concepts)
        return graph.settled(entities.with_roles(promoted, r["classes"], self.conventions))

    def _edges(self, kind: str) -> DataFrame:
        r = self.relations
        if kind == "CoOccurs":
            return vocabulary.co_occurrence(self.tokens, self.concepts).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("CoOccurs").alias("kind"), "weight")
        if kind == "AbbreviationOf":
            return graph.abbreviation_edges(self.concepts)
        if kind == "Contrastive":
            lists = r["signatures"].select(F.concat_ws("|", "file", F.col("line").cast("string"), "name").alias("list_id"), F.explode("params").alias("p")).select("list_id", "p.name")
            return graph.contrastive_edges(self.concepts, lists, self.links("AbbreviationOf"))
        if kind == "Instantiates":
            return entities.instantiates(self.entities)
        if kind == "MemberOf":
            return entities.member_of(self.entities)
        if kind == "InheritsFrom":
            return entities.inherits_from(self.entities, r["classes"])
        if kind == "Uses":
            imports = r["imports"]
            if imports.isEmpty():
                return entities.uses(self.entities, r["call_sites"])
            known = imports if "resolved_file" in imports.columns else entities.resolve_imports(imports, r["identifiers"].select("file").distinct())
            return entities.uses(self.entities, r["call_sites"], known)
        similar, _ = graph.similar_edges(self.concept_vectors.join(self.concept_clusters, "id"), "id", "label", "vector")
        contrast = self.links("Contrastive")
        apart = contrast.select("source", "target").unionByName(contrast.select(F.col("target").alias("source"), F.col("source").alias("target")))
        return similar.join(apart, ["source", "target"], "left_anti")

    def links(self, *kinds: str) -> DataFrame:
        for k in kinds:
            if k not in self._made and (k != "SimilarTo" or self.params.embed):
                self._made[k] = graph.settled(self._edges(k).select("source", "target", "kind", "weight"))
        return reduce(DataFrame.unionByName, [self._made[k] for k in kinds if k in self._made])

    @cached_property
    def edges(self) -> DataFrame:
        return self.links(*EDGES)

    @cached_property
    def centrality(self) -> DataFrame:
        return graph.pagerank(self.entities.select("id").distinct(), self.links("Uses", "InheritsFrom"))

    @cached_property
    def doc_context(self) -> DataFrame:
        return vocabulary.doc_context(self.concepts, self.relations["doc_texts"])

    @cached_property
    def concept_vectors(self) -> DataFrame | None:
        if not self.params.embed:
            return None
        names = self.occurrences.groupBy("canonical").agg(F.array_sort(F.collect_set("identifier")).alias("ids"))
        texts = self.concepts.join(names, "canonical").join(self.doc_context, "canonical", "left")
        words = F.flatten(F.transform(F.coalesce("doc_context", F.array().cast("array<string>")), lambda x: F.split(x, r"\s+")))
        texts = texts.select(F.col("canonical").alias("id"), concept_text(F.col("canonical"), F.array("canonical"), F.col("ids"), words).alias("text"))
        return graph.settled(embedding.embed(texts, self.embedder))

    @cached_property
    def concept_clusters(self) -> DataFrame | None:
        return _clustered(self.concept_vectors, 1 - self.params.concept_similarity) if self.params.embed else None

    @cached_property
    def logic_vectors(self) -> DataFrame | None:
        if not self.params.embed:
            return None
        bodies = self.relations["bodies"].select(F.concat_ws("|", "entity_name", "file").alias("at"), "body_text")
        texts = self.entities.where("kind <> 'class'").select("id", F.concat_ws("|", "name", "file").alias("at")).join(bodies, "at").groupBy("id").agg(F.min("body_text").alias("text"))
        return graph.settled(embedding.embed(texts, self.embedder))

    @cached_property
    def _logic(self) -> DataFrame:
        return _clustered(self.logic_vectors, 1 - self.params.logic_similarity)

    @cached_property
    def logic_clusters(self) -> DataFrame | None:
        if not self.params.embed:
            return None
        named = clusters.cluster_labels(self._logic.select(F.col("id").alias("entity"), "label"), entities.entity_calls(self.entities, self.relations["call_sites"]))
        return graph.settled(self._logic.join(named, "label"))

    @cached_property
    def overlaps(self) -> DataFrame | None:
        if not self.params.embed:
            return None
        labels = self.concept_clusters.select(F.col("id").alias("canonical"), F.col("label").alias("b"))
        first = self.entities.select("id", F.posexplode("tags").alias("pos", "canonical")).join(labels, "canonical").groupBy("id").agg(F.min_by("b", "pos").alias("b"))
        return clusters.cross_reference(self._logic.select("id", F.col("label").alias("a")), first, self.params.overlap)


def build(relations: dict[str, DataFrame], params: Params = Params(), configured: DataFrame | None = None) -> Ontology:  # noqa: B008
    """Analyse relations, each part when it is first asked for."""
    return Built(relations, params, configured)


def _clustered(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, label) by average linkage; ids become numbers by rank for the kernel and are put back."""
    numbered = graph.settled(vectors.select(F.xxhash64("id").alias("n"), "id", "vector"))
    labels = clusters.cluster(numbered.select(F.col("n").alias("id"), "vector"), threshold).withColumnsRenamed({"id": "n", "label": "m"})
    back = numbered.select("n", "id").join(labels, "n")
    least = back.groupBy("m").agg(F.min("id").alias("label"))
    return graph.settled(back.join(least, "m").select("id", "label"))
