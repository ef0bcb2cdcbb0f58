"""Connected components of an edge table by alternating star contractions.

Every step is an aggregation and an equi-join on whole tables; nothing is
gathered on the driver and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.runtime import discard, materialize


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of x moves to the smallest of x and its neighbours."""
    b = _both(e)
    m = b.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
    return b.where("y > x").join(m, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """x and its smaller neighbours move to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    m = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(m, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(m.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v longs); root is the component's smallest node."""
    e = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        old, e = e, materialize(_small(_large(e)), "edges")
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
