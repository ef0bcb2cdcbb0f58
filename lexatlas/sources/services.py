"""Answers of outside services: asked once for each key with bounded retries, parsed by schema, kept in a cache table.

The call itself is a function argument that runs on the executors, so any
client fits in (and none is needed where the answers are tables already).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.runtime import exists, materialize, remove, ship_package

#: Text put behind a surface form that is looked up without a context.
PLACEHOLDERS = {"en": " is a concept we want to find", "de": " ist ein Begriff, den wir finden wollen", "es": " es un concepto que queremos encontrar"}
#: Texts of at most so many characters are sent as short texts.
SHORT_TEXT = 6
#: New answers that a cache holds back before it is written.
FLUSH_AFTER = 200
_ENTITY = "struct<rawName: string, wikidataId: string, offsetStart: int, offsetEnd: int, nerd_score: double, nerd_selection_score: double>"
_STATEMENT = "struct<propertyId: string, value: string, valueName: string>"


def fetched(keys: DataFrame, fetch: Callable[[str], str | None], max_retries: int = 2, pause: float = 0.0) -> DataFrame:
    """key, response (null where all tries failed), tries for every distinct ``keys`` (key string).

    A try fails when ``fetch`` raises; ``pause`` seconds grow with each one.
    """
    ship_package(keys.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, tries = [], []
            for key in batch.column(0).to_pylist():
                answer, n = None, 0
                while n < max_retries:
                    n += 1
                    try:
                        answer = fetch(key)
                        break
                    except Exception:  # whatever the client raises is a failed try
                        time.sleep(pause * n)
                answers.append(answer)
                tries.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(tries, pa.int32())], names=["key", "response", "tries"])

    return keys.select("key").where("key is not null").distinct().mapInArrow(run, "key string, response string, tries int")


def disambiguation_request(text: Column, lang: str) -> Column:
    """The body of a request for the entities of a text."""
    language = F.struct(F.lit(lang).alias("lang"))
    return F.when(F.length(text) > SHORT_TEXT, F.to_json(F.struct(language.alias("language"), text.alias("text")))).otherwise(F.to_json(F.struct(language.alias("language"), text.alias("shortText"))))


def entity_candidates(answers: DataFrame) -> DataFrame:
    """key, pos, wikidataId, offsetStart, offsetEnd, rawName, nerd_score, nerd_selection_score of disambiguation answers (key, response)."""
    parsed = answers.select("key", F.from_json("response", f"entities array<{_ENTITY}>").alias("r"))
    return parsed.select("key", F.posexplode("r.entities").alias("pos", "e")).select("key", "pos", "e.*")


def concept_edges(answers: DataFrame) -> DataFrame:
    """child, property, parent, label of concept answers (key, response)."""
    parsed = answers.select("key", F.from_json("response", f"statements array<{_STATEMENT}>").alias("r"))
    each = parsed.select("key", F.explode("r.statements").alias("s"))
    return each.select(F.col("key").alias("child"), F.col("s.propertyId").alias("property"), F.col("s.value").alias("parent"), F.col("s.valueName").alias("label"))


def preferred_labels(answers: DataFrame) -> DataFrame:
    """wid, label of concept answers that name their concept."""
    parsed = answers.select(F.from_json("response", "wikidataId string, preferredTerm string").alias("r")).select("r.*")
    return parsed.where("wikidataId is not null and preferredTerm is not null").select(F.col("wikidataId").alias("wid"), F.col("preferredTerm").alias("label"))


class Cache:
    """Answers by key as a Parquet table that grows by appended parts; the first answer of a key stays."""

    def __init__(self, spark: SparkSession, path: str, flush_after: int = FLUSH_AFTER) -> None:
        self.spark, self.path, self.flush_after = spark, path, flush_after
        self.pending: list[DataFrame] = []
        self.misses = 0

    def table(self) -> DataFrame:
        """key, response of everything known, written or not."""
        known = self.spark.createDataFrame([], "key string, response string")
        if exists(self.spark, self.path):
            known = self.spark.read.schema("key string, response string").parquet(self.path)
        for part in self.pending:
            known = known.unionByName(part.join(known.select("key"), "key", "left_anti"))
        return known

    def lookup(self, keys: DataFrame, fetch: Callable[[str], str | None], max_retries: int = 2) -> DataFrame:
        """key, response of all ``keys``; unknown ones are fetched, failures are answers too."""
        asked = keys.select("key").where("key is not null").distinct()
        new = materialize(fetched(asked.join(self.table().select("key"), "key", "left_anti"), fetch, max_retries).select("key", "response"), "answers")
        self.store(new)
        return asked.join(self.table(), "key")

    def store(self, answers: DataFrame) -> int:
        """Adds answers (key, response) of keys not known yet; their number."""
        new = materialize(answers.dropDuplicates(["key"]).join(self.table().select("key"), "key", "left_anti").select("key", "response"), "answers")
        n = new.count()
        if n:
            self.pending.append(new)
            self.misses += n
        self.flush(only_expired=True)
        return n

    def flush(self, only_expired: bool = False) -> bool:
        """Writes what is held back, with ``only_expired`` only if it is more than ``flush_after`` answers."""
        if self.misses == 0 or only_expired and self.misses <= self.flush_after:
            return False
        for part in self.pending:
            part.write.mode("append").parquet(self.path)
        self.pending, self.misses = [], 0
        return True

    def clear(self) -> None:
        self.pending, self.misses = [], 0
        remove(self.spark, self.path)


def responds(spark: SparkSession, fetch: Callable[[str], str | None], probe: str = "Albert Einstein") -> bool:
    """Whether a service answers for a well-known name."""
    row = fetched(spark.createDataFrame([(probe,)], "key string"), fetch, 1).first()
    return row.response is not None
