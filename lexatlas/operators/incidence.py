"""Formal contexts as sparse incidence pairs (obj, att)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def incidence(lists: DataFrame, obj: str, atts: str, k: int | None = None) -> DataFrame:
    """Distinct (obj, att) of rows with attribute lists; ``k`` keeps the first so many of each list."""
    values = F.slice(atts, 1, k) if k else F.col(atts)
    return lists.select(F.col(obj).alias("obj"), F.explode(values).alias("att")).distinct()


def extents(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("att").agg(F.array_sort(F.collect_set("obj")).alias("extent"))


def intents(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("obj").agg(F.array_sort(F.collect_set("att")).alias("intent"))


def common_objects(pairs: DataFrame, atts: DataFrame) -> DataFrame:
    """Objects that have all of ``atts`` (att): relational division by counting."""
    wanted = atts.select("att").distinct()
    need = wanted.agg(F.count("*").alias("need"))
    have = pairs.join(wanted, "att", "left_semi").groupBy("obj").agg(F.count("*").alias("have"))
    return have.join(F.broadcast(need), F.col("have") == F.col("need")).select("obj")


def common_attributes(pairs: DataFrame, objs: DataFrame) -> DataFrame:
    """Attributes that all of ``objs`` (obj) have."""
    flipped = pairs.select(F.col("att").alias("obj"), F.col("obj").alias("att"))
    return common_objects(flipped, objs.select(F.col("obj").alias("att"))).select(F.col("obj").alias("att"))


def closure(pairs: DataFrame, atts: DataFrame) -> DataFrame:
    return common_attributes(pairs, common_objects(pairs, atts))


def drop_rare(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Drop attributes of fewer than log10(#objects) + 1 objects (within each group of ``by``)."""
    by = by or []
    objects = pairs.groupBy(*by).agg(F.countDistinct("obj").alias("n"))
    sizes = pairs.groupBy(*by, "att").agg(F.count("*").alias("e"))
    kept = sizes.join(objects, by) if by else sizes.join(F.broadcast(objects))
    kept = kept.where(F.col("e") >= F.log10("n") + 1).select(*by, "att")
    return pairs.join(kept, [*by, "att"], "left_semi")


def clarify(pairs: DataFrame) -> DataFrame:
    """One representative (the least name) of the objects with equal attributes."""
    one = intents(pairs).groupBy("intent").agg(F.min("obj").alias("obj"))
    return pairs.join(one.select("obj"), "obj", "left_semi")


def drop_full(pairs: DataFrame) -> DataFrame:
    """Drop objects that have every attribute (those without any have no pairs)."""
    total = pairs.agg(F.countDistinct("att").alias("total"))
    sizes = pairs.groupBy("obj").agg(F.count("*").alias("n"))
    kept = sizes.join(F.broadcast(total), F.col("n") < F.col("total")).select("obj")
    return pairs.join(kept, "obj", "left_semi")


def clean(pairs: DataFrame, min_extent: int | None = None, min_length: int | None = None) -> DataFrame:
    """Drop attributes of few objects or short names; nothing happens without limits. Objects may end up without pairs."""
    if (min_extent is None or min_extent <= 1) and not min_length:
        return pairs
    kept = pairs.groupBy("att").agg(F.count("*").alias("n"))
    if min_extent is not None:
        kept = kept.where(F.col("n") >= min_extent)
    if min_length:
        kept = kept.where(F.length("att") >= min_length)
    return pairs.join(kept.select("att"), "att", "left_semi")


def accepted(factors: DataFrame, by: list[str]) -> DataFrame:
    """Factors (by..., i, score) before the first whose score is under sum(accepted) / (number accepted + 3)."""
    prior = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.coalesce(F.sum("score").over(prior) / (F.count("*").over(prior) + 3), F.lit(0.0))
    upto = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    failed = factors.withColumn("failed", F.col("score") < limit)
    return failed.withColumn("stop", F.max(F.col("failed").cast("int")).over(upto)).where("stop = 0").drop("failed", "stop")
