"""Files under the names that other programs exchange them by: one JSON file of senses, one JSON file for each type."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.runtime import open_uri, ship_package

#: Entities of a snapshot of senses.
SNAPSHOT = 11


def senses_path(stem: str, m: int, max_k: int, snapshot: int | None = None) -> str:
    """Name of a file of senses; ``snapshot``: number of the last entity of an early part."""
    return f"{stem}_m{m}_k{max_k}" + (f"_{snapshot}" if snapshot is not None else "") + ".json"


def keyed_senses(senses: DataFrame) -> DataFrame:
    """key, descriptors: the key gets ``##i`` only where an entity has several senses."""
    many = F.count("*").over(Window.partitionBy("entity")) > 1
    return senses.select("entity", F.when(many, F.concat_ws("##", "entity", "sense_ix")).otherwise(F.col("entity")).alias("key"), "descriptors")


def write_senses_file(senses: DataFrame, stem: str, m: int, max_k: int, snapshot: int | None = None) -> str:
    """One JSON object of all senses (or of the entities up to number ``snapshot``), a line per key; its path.

    A single file has a single writer: its task gets the rows in order and holds a batch of them at a time.
    """
    spark = senses.sparkSession
    ship_package(spark)
    if snapshot is not None:
        senses = senses.join(senses.select("entity").distinct().orderBy("entity").limit(snapshot + 1), "entity", "left_semi")
    path = senses_path(stem, m, max_k, snapshot)
    line = F.concat(F.to_json(F.array("key")), F.lit("\t"), F.to_json("descriptors"))  # the key in brackets
    rows = keyed_senses(senses).select("entity", "key", line.alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open_uri(path, "w") as out:
            out.write(b"{")
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    key, descriptors = text.split("\t")
                    out.write(("," * (n > 0) + f"\n  {key[1:-1]}: {descriptors}").encode())
                    n += 1
            out.write(b"\n}\n")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["keys"])

    rows.repartition(1).sortWithinPartitions("entity", "key").select("line").mapInArrow(run, "keys long").collect()  # one number
    return path


def type_path(folder: str, m: int | None, k: int, th: int, i: int) -> str:
    """Name of a type file; without ``m`` the folder is that of one m already."""
    return folder + (f"/m{m}" if m is not None else "") + f"/k{k}_th{th}/k{k}_th{th}_type{i}.json"


def write_type_files(types: DataFrame, folder: str) -> int:
    """One JSON file per row of ``types`` (m, k, th, type_ix, score, descriptors, entities); their number."""
    ship_package(types.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for r in batch.to_pylist():
                with open_uri(type_path(folder, r["m"], r["k"], r["th"], r["type_ix"]), "w") as out:
                    out.write(json.dumps({x: r[x] for x in ("score", "descriptors", "entities")}, indent=2, ensure_ascii=False).encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    written = types.select("m", "k", "th", "type_ix", "score", "descriptors", "entities").mapInArrow(run, "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def read_type_files(spark: SparkSession, folder: str) -> DataFrame:
    """m, k, th, type_ix, score, descriptors, entities of the type files of every folder ``m../k.._th..``.

    Of each folder the unbroken run of readable files from number 0 counts.
    """
    raw = spark.read.text(f"{folder}/m*/k*_th*/k*_th*_type*.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("int")
    body = F.from_json("value", "score double, descriptors array<string>, entities array<string>")
    rows = raw.select(number(r"/m(\d+)/[^/]*/[^/]*$").alias("m"), number(r"/k(\d+)_th\d+/[^/]*$").alias("k"), number(r"/k\d+_th(\d+)/[^/]*$").alias("th"), number(r"_type(\d+)\.json$").alias("type_ix"), body.alias("b"))
    fine = rows.select("m", "k", "th", "type_ix", "b.*").where("descriptors is not null and entities is not null")
    at = F.row_number().over(Window.partitionBy("m", "k", "th").orderBy("type_ix")) - 1
    return fine.withColumn("at", at).where("type_ix = at").drop("at")
