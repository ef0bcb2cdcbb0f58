"""Tab-separated mention and evaluation tables, JSON sense and type files, knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions.text import split_key, strip

NO_ENTITY = "no.entity.found"
#: The columns of the exchanged files.
MENTION_COLUMNS = "`NE::tag` string, `Start offset` int, `End offset` int, `Context` string, `URI` string"
EVALUATION_COLUMNS = (
    "k int, m int, th int, linker string, oddsratios_probs_vs_random_LIB double, above2std_of_oddsrations_vs_random_HIB double, "
    "KL_vs_random_HIB double, number_of_candidates int, average_candidate_size double, maximum_candidate_size int, "
    "minumum_candidate_size int, proportion_significantly_enriched_HIB double, proportion_matching_smaller_than_average_broaders_HIB double, max_pvalue double"
)


def _tsv(spark: SparkSession, path: str, schema: str, **more) -> DataFrame:
    return spark.read.options(sep="\t", header=True, quote="", **more).schema(schema).csv(path)


#: Columns that order mentions as their files do.
FILE_ORDER = ("file", "stretch", "line")


def read_mentions(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """ne, tag, start, end, context, uri of linked mentions; an entity that was not found becomes its surface form.

    ``numbered`` adds FILE_ORDER, which puts the rows in the order of the files' names and lines.
    """
    raw = _tsv(spark, path, MENTION_COLUMNS)
    ne, tag = split_key("NE::tag")
    uri = strip("URI")
    places = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()) if numbered else ()
    return raw.select(*(c.alias(n) for c, n in zip(places, FILE_ORDER, strict=False)), ne.alias("ne"), tag.alias("tag"), F.col("Start offset").alias("start"), F.col("End offset").alias("end"), F.col("Context").alias("context"), F.when(uri.contains(NO_ENTITY), ne).otherwise(uri).alias("uri"))


def write_mentions(mentions: DataFrame, path: str) -> None:
    out = mentions.select(
        F.concat_ws("::", "ne", F.coalesce("tag", F.lit(""))).alias("NE::tag"), F.col("start").alias("Start offset"), F.col("end").alias("End offset"), F.col("context").alias("Context"), F.col("uri").alias("URI"),
    )
    out.write.mode("overwrite").options(sep="\t", header=True, quote="", escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def surface_forms(mentions: DataFrame, order: str = "mention_id") -> DataFrame:
    """uri, surface: the first lower-cased ``ne::tag`` string of each linked uri."""
    named = mentions.where(~F.col("uri").contains(NO_ENTITY)).withColumn("surface", F.lower(strip(F.concat_ws("::", "ne", "tag"))))
    return named.groupBy("uri").agg(F.min_by("surface", order).alias("surface"))


def read_senses(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """entity, sense_ix (null for a single sense), descriptors of JSON maps, one per line or (``lines`` false) one per file."""
    maps = spark.read.text(path, wholetext=not lines)
    rows = maps.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "descriptors"))
    index = F.when(F.col("key").contains("##"), F.substring_index("key", "##", -1).cast("int"))
    return rows.select(F.substring_index("key", "##", 1).alias("entity"), index.alias("sense_ix"), "descriptors")


def senses_json(senses: DataFrame) -> DataFrame:
    """entity, json: one JSON object per entity; the key gets ``##i`` only where an entity has several senses.

    Rows stay apart, so a table of any size can be written, one JSON map per line.
    """
    many = F.count("*").over(Window.partitionBy("entity")) > 1
    keyed = senses.withColumn("key", F.when(many, F.concat_ws("##", "entity", "sense_ix")).otherwise(F.col("entity")))
    return keyed.groupBy("entity").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "descriptors"))))).alias("json"))


def write_senses(senses: DataFrame, path: str) -> None:
    senses_json(senses).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_types(types: DataFrame, path: str) -> None:
    """One folder per (m, k, th), a JSON row per type."""
    types.select("m", "k", "th", "type_ix", "score", "descriptors", "entities").write.mode("overwrite").partitionBy("m", "k", "th").json(path)


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """Types of every (m, k, th) folder, pruned by partition; only the unbroken run of type numbers from 0 counts."""
    raw = spark.read.schema("type_ix int, score double, descriptors array<string>, entities array<string>, m int, k int, th int").json(path)
    fine = raw.where("type_ix is not null and entities is not null")
    at = F.row_number().over(Window.partitionBy("m", "k", "th").orderBy("type_ix")) - 1
    return fine.withColumn("at", at).where("type_ix = at").drop("at")


def params_of_path(path: F.Column) -> dict[str, F.Column]:
    """m, k and th from ``.../m30/k50_th6``."""
    got = lambda name: F.regexp_extract(path, rf"(?:^|[/_]){name}([0-9]+(?:\.[0-9]+)?)(?=[/_]|$)", 1)
    return {name: F.when(got(name) != "", got(name).cast("double")) for name in ("m", "k", "th")}


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; short or unreadable rows are skipped."""
    return _tsv(spark, path, EVALUATION_COLUMNS, mode="DROPMALFORMED")


def write_evaluation(rows: DataFrame, path: str) -> None:
    names = [c.strip().split(" ")[0] for c in EVALUATION_COLUMNS.split(",")]
    rows.select(*names).write.mode("overwrite").options(sep="\t", header=True).csv(path)


def evaluation_json(rows: DataFrame, results: list[str], params: dict) -> DataFrame:
    """One JSON document per experiment: candidates, results and parameters."""
    given = F.struct(*(F.lit(v).alias(k) for k, v in params.items()))
    return rows.select(F.to_json(F.struct(F.col("candidate_types"), F.struct(*results).alias("evaluation_results"), given.alias("evaluation_parameters"))).alias("value"))


def labels_for(ids: DataFrame, labels: DataFrame, lang: str, fallback: str = "en") -> DataFrame:
    """``ids`` (wid) with label: the language's, else the fallback's, else the id itself."""
    short = F.substring("lang", 1, 2)
    pick = lambda x, name: labels.where(short == x).groupBy("wid").agg(F.min("label").alias(name))
    both = ids.join(pick(lang, "own"), "wid", "left").join(pick(fallback, "other"), "wid", "left")
    return both.withColumn("label", F.coalesce("own", "other", "wid")).drop("own", "other")
