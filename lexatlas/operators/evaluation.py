"""Experiment metrics and their grids over the parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.operators.nullmodel import above_random, divergence, mean_tail

MISSING = -1


def large_enough(candidates: DataFrame, min_size: int, by: list[str]) -> DataFrame:
    """Candidates of at least ``min_size`` entities, of experiments that keep two or more."""
    fit = candidates.where(F.size("entities") >= min_size)
    some = fit.groupBy(*by).agg(F.count("*").alias("n")).where("n >= 2").select(*by)
    return fit.join(some, by, "left_semi")


def experiment_metrics(enriched: DataFrame, by: list[str], threshold: float = 0.05) -> DataFrame:
    """One row per experiment: sizes, shares of enriched candidates, greatest p-value.

    ``enriched``: by, entities, n_broaders, best_p, top_p, top_surprise (nulls
    where a candidate has no over-represented broader). The limit of a
    candidate is ``threshold`` over all its broaders.
    """
    size = F.size("entities")
    limit = threshold / F.col("n_broaders")
    return enriched.groupBy(*by).agg(
        F.count("*").alias("number_of_candidates"),
        F.avg(size).alias("average_candidate_size"),
        F.max(size).alias("maximum_candidate_size"),
        F.min(size).alias("minumum_candidate_size"),
        (F.count_if(F.col("best_p") < limit) / F.count("*")).alias("proportion_significantly_enriched_HIB"),
        (F.count_if((F.col("top_p") < limit) & (F.col("top_surprise") < 1)) / F.count("*")).alias("proportion_matching_smaller_than_average_broaders_HIB"),
        F.max(F.coalesce("best_p", F.lit(2 * threshold))).alias("max_pvalue"),
    )


def experiment_rows(enriched: DataFrame, random_values: DataFrame, by: list[str], threshold: float = 0.05, deviations: float = 2.0) -> DataFrame:
    """One evaluation row per experiment: ``experiment_metrics`` and how the best p-values compare with those of random classes.

    ``random_values``: by, best_p of every random class. Without any the three comparisons are 0; where those there are have no density
    (a single one, or equal ones), tail and divergence are null.
    """
    values = enriched.select(*by, F.col("best_p").alias("value"), F.lit(False).alias("is_random")).unionByName(random_values.select(*by, F.col("best_p").alias("value"), F.lit(True).alias("is_random")))
    some = random_values.where("best_p is not null").select(*by).distinct().withColumn("some", F.lit(True))
    out = experiment_metrics(enriched, by, threshold)
    for part in (mean_tail(values, by), above_random(values, by, deviations), divergence(values, by)):
        out = out.join(part, by, "left")
    out = out.join(some, by, "left")
    filled = lambda c: F.when(F.col("some"), F.col(c)).otherwise(F.lit(0)).cast("double")
    out = out.withColumns({"oddsratios_probs_vs_random_LIB": filled("tail"), "above2std_of_oddsrations_vs_random_HIB": F.coalesce(filled("above"), F.lit(0.0)), "KL_vs_random_HIB": filled("kl")})
    return out.drop("tail", "above", "kl", "some")


def excluded() -> Column:
    return F.col("th").isin(5, 6) & (F.col("k") == 10)


def normalised(rows: DataFrame) -> DataFrame:
    """Adds 1 - the random tail, and counts over the number of candidates."""
    return rows.withColumn("one_minus_avg_pval_oddsratios_HIB", 1 - F.col("oddsratios_probs_vs_random_LIB")).withColumn(
        "above2std_of_oddsrations_vs_random_normalized_HIB", F.col("above2std_of_oddsrations_vs_random_HIB") / F.col("number_of_candidates")
    )


def best_rows(rows: DataFrame, criterion: str, by: str = "linker") -> DataFrame:
    """The rows with the greatest value of the criterion, ties kept."""
    order = Window.partitionBy(by).orderBy(F.desc(criterion))
    return rows.where(F.col(criterion).isNotNull()).withColumn("r", F.rank().over(order)).where("r = 1").drop("r")


def bounds(rows: DataFrame, criteria: list[str], cap: dict[str, float] | None = None) -> DataFrame:
    """criterion, least, most over rows that are not excluded; only finite values count for the greatest."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("v")) for c in criteria)))
    long = rows.where(~excluded()).select(each.alias("x")).select("x.*").where("v is not null and not isnan(v)")
    found = long.groupBy("criterion").agg(F.min("v").alias("least"), F.max(F.when(F.abs("v") < float("inf"), F.col("v"))).alias("most"))
    for c, top in (cap or {}).items():
        found = found.withColumn("most", F.when(F.col("criterion") == c, F.least("most", F.lit(top))).otherwise(F.col("most")))
    return found


def axis_values(rows: DataFrame, params: list[str]) -> DataFrame:
    """param, value: distinct values of each parameter."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params)))
    return rows.select(each.alias("x")).select("x.*").where("value is not null").distinct()


def grid(rows: DataFrame, criterion: str, order: str, keys: tuple[str, ...] = ("linker", "th", "k", "m")) -> DataFrame:
    """linker, th, k, m, value for every combination of the axis values; the first row of a cell wins, -1 where there is none."""
    axes = None
    for key in keys:
        values = rows.select(key).where(F.col(key).isNotNull()).distinct()
        axes = values if axes is None else axes.crossJoin(values)  # distinct parameter values of an experiment grid
    first = rows.groupBy(*keys).agg(F.min_by(criterion, order).alias("value"))
    return axes.join(first, list(keys), "left").withColumn("value", F.coalesce("value", F.lit(float(MISSING))))


def matrix(cells: DataFrame, columns: list) -> DataFrame:
    """linker, th, k and one column per m."""
    return cells.groupBy("linker", "th", "k").pivot("m", columns).agg(F.first("value")).na.fill(float(MISSING))
