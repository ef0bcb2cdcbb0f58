"""Entity linkers over tables: spans, dummy URIs, types, broaders, labels."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.functions.text import is_uri, local_name, strip, without_sense
from lexatlas.sources.services import PLACEHOLDERS
from lexatlas.sources.tables import labels_for

ENTITY_PREFIX = "<http://www.wikidata.org/entity/"
MIN_SCORE = 0.2
#: Concepts too general to be a broader, and the properties that lead to broaders.
IGNORED = ("Q16889133", "Q35120", "Q36161")
PROPERTIES = ("P279", "P31")


def link_key(surface: Column, context: Column | None = None) -> Column:
    """A name for a surface form in its context, the same in every run."""
    return F.concat(F.md5(surface), F.lit("_@_"), F.md5(F.lit("") if context is None else context))


def made_uri(surface: Column) -> Column:
    """An address for a concept no linker knows, the same in every run."""
    h = F.md5(surface)
    part = lambda at, n: F.substring(h, at, n)
    name = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return F.concat(F.lit("<https://some.uri/"), name, F.lit("/"), F.regexp_replace(F.lower(strip(surface)), r"(?U)\s+", "_"), F.lit(">"))


def standalone(surfaces: DataFrame, lang: str) -> DataFrame:
    """``surfaces`` (ne) as mentions (context_id, ne, context, start, end) in a made-up context."""
    context = F.concat("ne", F.lit(PLACEHOLDERS.get(lang, PLACEHOLDERS["en"])))
    return surfaces.select("ne").distinct().select(link_key(F.col("ne"), context).alias("context_id"), "ne", context.alias("context"), F.lit(0).alias("start"), F.length("ne").alias("end"))


class EntityLinker(Protocol):
    """What a linker offers; every method maps DataFrames to DataFrames."""

    def link(self, mentions: DataFrame) -> DataFrame:
        """``mentions`` with uri."""

    def broaders(self, entities: DataFrame) -> DataFrame:
        """(entity, broader) for entities (entity)."""

    def labels(self, ids: DataFrame) -> DataFrame:
        """(uri, label)."""


def dummy_uri(surface: Column) -> Column:
    return F.concat(F.lit("<"), F.regexp_replace(F.lower(strip(surface)), r"(?U)\s+", "_"), F.lit(">"))


def dummy_broaders(uri: Column) -> Column:
    """Array of made-up broaders from the first five characters of the local name."""
    path = F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))
    name = F.when(is_uri(uri), path).otherwise(F.regexp_replace(uri, r"(?U)\s+", "_"))
    size = F.least(F.lit(5), F.length(name))
    one = lambda i: F.concat(F.lit("<https://broaders.url/"), F.upper(F.substring(name, i + 1, F.lit(1))), i.cast("string"), F.lit(">"))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), one)).otherwise(F.array().cast("array<string>"))


class DummyLinker:
    def link(self, mentions: DataFrame) -> DataFrame:
        return mentions.withColumn("uri", dummy_uri(F.col("ne")))

    def broaders(self, entities: DataFrame) -> DataFrame:
        return entities.select("entity", F.explode(dummy_broaders(F.col("entity"))).alias("broader"))

    def labels(self, ids: DataFrame) -> DataFrame:
        return ids.select("uri", F.col("uri").alias("label"))


class TypeLinker:
    """Broaders are the entity tags seen with a uri (or a surface form) in linked mentions."""

    def __init__(self, mentions: DataFrame) -> None:
        self.mentions = mentions

    def link(self, mentions: DataFrame) -> DataFrame:
        """Exact (ne, context) lookup; an unknown pair has a null uri."""
        known = self.mentions.groupBy("ne", "context").agg(F.min("uri").alias("uri"))
        return mentions.join(known, ["ne", "context"], "left")

    def types(self) -> DataFrame:
        return self.mentions.where(F.col("tag").isNotNull()).select(F.col("uri").alias("entity"), F.col("tag").alias("broader")).distinct()

    def broaders(self, entities: DataFrame) -> DataFrame:
        plain = entities.select("entity", without_sense("entity").alias("plain"))
        return plain.join(self.types().withColumnRenamed("entity", "plain"), "plain").select("entity", "broader")

    def labels(self, ids: DataFrame) -> DataFrame:
        return ids.select("uri", F.col("uri").alias("label"))


def best_spans(mentions: DataFrame, candidates: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``mentions`` with the uri of the candidate span that overlaps best.

    ``mentions``: context_id, ne, start, end. ``candidates``: context_id, pos,
    wikidataId, offsetStart, offsetEnd, nerd_score, nerd_selection_score. A
    candidate needs all of id and offsets, to touch the mention, a score over
    0.8 times the least score (a missing score is just above it) and a Jaccard
    overlap over one half; the greatest overlap wins, then the earlier place;
    without any the surface form in angle brackets is the uri.
    """
    whole = candidates.where("wikidataId is not null and offsetStart is not null and offsetEnd is not null")
    c = whole.select("context_id", "pos", "wikidataId", "offsetStart", "offsetEnd", F.coalesce(F.greatest("nerd_score", "nerd_selection_score"), F.lit(min_score + 0.01)).alias("score"))
    c = c.where(F.col("score") > 0.8 * min_score)
    m = mentions.select("context_id", "start", "end").distinct()
    meet = m.join(c, "context_id").where("offsetStart <= end and offsetEnd >= start")
    overlap = F.least("end", "offsetEnd") - F.greatest("start", "offsetStart")
    jaccard = overlap / (F.greatest("end", "offsetEnd") - F.least("start", "offsetStart"))
    ranked = meet.withColumn("jaccard", jaccard).where("jaccard > 0.5")
    best = ranked.groupBy("context_id", "start", "end").agg(F.min_by("wikidataId", F.struct((-F.col("jaccard")).alias("j"), "pos")).alias("wid"))
    found = mentions.join(best, ["context_id", "start", "end"], "left")
    uri = F.coalesce(F.concat(F.lit(ENTITY_PREFIX), "wid", F.lit(">")), F.concat(F.lit("<"), "ne", F.lit(">")))
    return found.withColumn("uri", uri).drop("wid")


def transitive_broaders(starts: DataFrame, edges: DataFrame, hops: int = 4, properties: tuple[str, ...] = PROPERTIES, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(entity, broader): everything within ``hops`` steps of each start (entity).

    Ignored concepts are neither reached nor passed. Steps are joins on the
    frontier that has not been seen, so cycles end and no step repeats work.
    """
    step = edges.where(F.col("property").isin(*properties) & ~F.col("parent").isin(*ignored)).select("child", "parent").distinct()
    frontier = starts.select("entity", F.col("entity").alias("node")).distinct()
    seen = None
    for _ in range(hops):
        reached = frontier.join(step, F.col("node") == F.col("child")).select("entity", F.col("parent").alias("node")).distinct()
        if seen is None:
            frontier = seen = reached
        else:
            frontier = reached.join(seen, ["entity", "node"], "left_anti")
            seen = seen.unionByName(frontier)
    return seen.select("entity", F.col("node").alias("broader"))


class GraphLinker:
    """Candidate spans, a concept graph and labels as tables."""

    def __init__(self, candidates: DataFrame, edges: DataFrame, labels: DataFrame, lang: str = "de", transitive: bool = True) -> None:
        self.candidates, self.edges, self.kb_labels, self.lang, self.hops = candidates, edges, labels, lang, 4 if transitive else 1

    def link(self, mentions: DataFrame) -> DataFrame:
        return best_spans(mentions, self.candidates)

    def broaders(self, entities: DataFrame) -> DataFrame:
        named = entities.select("entity", local_name(without_sense("entity")).alias("wid"))
        found = transitive_broaders(named.select(F.col("wid").alias("entity")), self.edges, self.hops)
        return named.join(found.withColumnRenamed("entity", "wid"), "wid").select("entity", "broader")

    def labels(self, ids: DataFrame) -> DataFrame:
        named = ids.select("uri", local_name(without_sense("uri")).alias("wid"))
        return labels_for(named, self.kb_labels, self.lang).select("uri", "label")

    def categories(self, entities: DataFrame) -> DataFrame:
        """(entity, category, label) by the instance-of property alone."""
        own = self.edges.where("property = 'P31'").select(F.col("child").alias("entity"), F.col("parent").alias("wid")).distinct()
        return labels_for(entities.join(own, "entity"), self.kb_labels, self.lang).select("entity", F.col("wid").alias("category"), "label")


def surfaces(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """entity, surface: the known surface form of the entity without its sense, else the entity itself."""
    plain = entities.select("entity", without_sense("entity").alias("uri"))
    return plain.join(forms.select("uri", "surface"), "uri", "left").select("entity", F.coalesce("surface", "entity").alias("surface"))

