"""Which broader concepts a class of entities is enriched in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions.stats import binomial_tail

REPRESENTATIVE = 0.1


def entity_set(candidates: DataFrame) -> DataFrame:
    """Distinct entities of all candidates."""
    return candidates.select(F.explode("entities").alias("entity")).distinct()


def broader_counts(candidates: DataFrame, broaders: DataFrame, key: str = "cand") -> DataFrame:
    """key, size, broader, n: entities (each time they occur) of the candidate with that broader."""
    each = candidates.select(key, F.size("entities").alias("size"), F.explode("entities").alias("entity"))
    return each.join(broaders, "entity").groupBy(key, "size", "broader").agg(F.count("*").alias("n"))


def corpus_shares(broaders: DataFrame) -> DataFrame:
    """broader, pairs, share of all (entity, broader) pairs, mean_share.

    Totals are one-row aggregates, not a window over everything.
    """
    counts = broaders.groupBy("broader").agg(F.count("*").alias("pairs"))
    total = counts.agg(F.sum("pairs").alias("total"), F.count("*").alias("kinds"))
    return counts.join(F.broadcast(total)).select("broader", "pairs", (F.col("pairs") / F.col("total")).alias("share"), (1 / F.col("kinds")).alias("mean_share"))


def enrichment(counts: DataFrame, shares: DataFrame, key: str = "cand", threshold: float = 0.1, num_best: int = 5, representative: float = REPRESENTATIVE) -> DataFrame:
    """key, rank, broader, n, size, p, significant, surprise: the best broaders of each candidate.

    Broaders over ``representative`` of the candidate and over their corpus
    share are tested against the binomial null model, each (size, share, count)
    once, with a Bonferroni limit over the tested ones; significant ones come
    first, then the others, each from the rarest.
    """
    good = counts.join(shares, "broader").where((F.col("n") > representative * F.col("size")) & (F.col("n") / F.col("size") > F.col("share")))
    tests = good.select("size", "share", "n").distinct().withColumn("p", binomial_tail(F.col("size"), F.col("share"), F.col("n")))
    tested = good.join(tests, ["size", "share", "n"])
    number = F.count("*").over(Window.partitionBy(key))
    marked = tested.withColumn("significant", F.col("p") < threshold / number)
    order = Window.partitionBy(key).orderBy(F.desc("significant"), "share", "broader")
    ranked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= num_best)
    return ranked.select(key, "rank", "broader", "n", "size", "p", "significant", (F.col("share") / F.col("mean_share")).alias("surprise"))


def enriched_candidates(candidates: DataFrame, counts: DataFrame, best: DataFrame, labels: DataFrame | None = None, key: str = "cand") -> DataFrame:
    """``candidates`` with broader_counts (map), log_odds (array), best_match_broader, its label and best_p (null without any)."""
    maps = counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("broader", "n")))).alias("broader_counts"))
    item = F.struct("rank", F.struct(F.col("broader").alias("candidatesbroader"), F.col("p").alias("loggods"), F.col("surprise").alias("suprise")).alias("o"))
    lists = best.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("l"), F.min_by("broader", "rank").alias("best_match_broader"), F.min_by("p", "rank").alias("best_p"))
    lists = lists.select(key, F.col("l.o").alias("log_odds"), "best_match_broader", "best_p")
    out = candidates.join(maps, key, "left").join(lists, key, "left")
    if labels is not None:
        named = labels.groupBy("broader").agg(F.min("label").alias("label"))
        out = out.join(named, F.col("best_match_broader") == named["broader"], "left").withColumn("best_match_broader_label", F.when(F.col("best_match_broader").isNull(), "").otherwise(F.coalesce("label", "best_match_broader"))).drop("broader", "label")
    return out


def log_odds(counts: DataFrame, broaders: DataFrame, n_entities: int | None = None, key: str = "cand", num_best: int = 5, representative: float = REPRESENTATIVE) -> DataFrame:
    """key, rank, broader, log_odds: ln of the candidate's share of a broader over the corpus's.

    Broaders over ``representative`` of the candidate, or all where none is.
    """
    world = broaders.groupBy("broader").agg(F.count("*").alias("tw"))
    total = broaders.agg(F.countDistinct("entity").alias("w")) if n_entities is None else None
    fit = F.col("n") > representative * F.col("size")
    any_fit = F.max(fit).over(Window.partitionBy(key))
    kept = counts.withColumn("fit", fit).withColumn("any_fit", any_fit).where("fit or not any_fit")
    joined = kept.join(world, "broader")
    joined = joined.join(F.broadcast(total)) if total is not None else joined.withColumn("w", F.lit(n_entities))
    odds = joined.withColumn("log_odds", F.ln((F.col("n") / F.col("size")) / (F.col("tw") / F.col("w"))))
    order = Window.partitionBy(key).orderBy(F.desc("log_odds"), "broader")
    return odds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= num_best).select(key, "rank", "broader", "log_odds")
