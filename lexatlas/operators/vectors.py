"""Sense disambiguation on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.functions.stats import cosine


def mean_vectors(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """by, centroid: component means, pre-aggregated before the shuffle."""
    each = vectors.select(by, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(by, F.col("v.x").alias("centroid"))


#: Senses of an inventory that may travel to every task, and of one block of a larger one.
MAX_SENSES = 1000


def disambiguate(targets: DataFrame, senses: DataFrame, definitions: DataFrame | None = None, vector: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """Every target row against the senses that share its ``by`` columns (say its lemma), or against all: adds sense and score (and def_score).

    ``senses`` ([by,] sense, centroid): an empty or missing centroid scores 0. Senses
    travel as arrays on target rows. An inventory for all targets is broadcast up to
    MAX_SENSES senses; a larger one meets the targets in blocks of about so many, dealt
    over all partitions. ``definitions``: sense, centroid.
    """
    inventory = senses
    if definitions is not None:
        inventory = senses.join(definitions.select("sense", F.col("centroid").alias("definition")), "sense", "left")
    else:
        inventory = senses.withColumn("definition", F.lit(None).cast("array<double>"))
    gathered = F.array_sort(F.collect_list(F.struct("sense", "centroid", "definition"))).alias("inventory")
    if by:
        met = targets.join(inventory.groupBy(*by).agg(gathered), by)
    elif (n := inventory.count()) <= MAX_SENSES:
        met = targets.join(F.broadcast(inventory.agg(gathered)))
    else:
        blocks, deals = -(-n // MAX_SENSES), int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        span = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        listed = inventory.withColumn("__block", F.pmod(F.hash("sense"), F.lit(blocks))).groupBy("__block").agg(gathered).withColumn("__deal", span(deals))
        dealt = targets.withColumn("__deal", F.pmod(F.hash(vector), F.lit(deals))).withColumn("__block", span(blocks))
        met = dealt.join(listed, ["__block", "__deal"]).drop("__block", "__deal")
    each = met.withColumn("s", F.explode("inventory")).drop("inventory")
    score = F.coalesce(cosine(F.col(vector), F.col("s.centroid")), F.lit(0.0))
    out = each.withColumn("sense", F.col("s.sense")).withColumn("score", score)
    if definitions is not None:
        out = out.withColumn("def_score", F.nullif(F.coalesce(cosine(F.col(vector), F.col("s.definition")), F.lit(0.0)), F.lit(0.0)))
    return out.drop("s")


def choose_sense(scored: DataFrame, by: str) -> DataFrame:
    """by, sense, score: the best sense, the first on ties."""
    best = scored.groupBy(by).agg(F.max(F.struct(F.col("score"), (-F.col("sense")).alias("o"))).alias("b"))
    return best.select(by, (-F.col("b.o")).alias("sense"), F.col("b.score").alias("score"))
