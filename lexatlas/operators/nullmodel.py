"""Random classes of the same sizes, and how induced classes compare with them."""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions.stats import kde, kde_mass
from lexatlas.runtime import materialize, ship_package

#: Bins of a group of values whose densities are compared.
BINS = 2048


def repaired(classes: list[list[str | None]], start: Callable[[str], int]) -> None:
    """Moves what a class holds twice until no class does; sizes and the bag of all entities stay.

    All doubled occurrences are taken out and placed one by one in a class that lacks the entity, from class
    ``start(entity)`` on; a full class passes another entity on to a class that lacks it, until one has room
    (augmenting paths, which exist as long as any deal without doubles does).
    """
    free: dict[int, list[int]] = {}
    loose = []
    has: list[set] = [set() for _ in classes]
    for c, entities in enumerate(classes):
        for p, e in enumerate(entities):
            if e in has[c]:
                loose.append(e)
                free.setdefault(c, []).append(p)
                entities[p] = None
            has[c].add(e)

    def passed(x: int, y: int, at: int) -> int | None:
        """Place of an entity of class x that class y lacks."""
        n = len(classes[x])
        return next((p for p in ((at + i) % n for i in range(n)) if classes[x][p] is not None and classes[x][p] not in has[y]), None)

    for e in loose:
        at = start(e)
        turn = [(at + i) % len(classes) for i in range(len(classes))]
        way: dict[int, tuple[int, int] | None] = {c: None for c in turn if e not in has[c] and classes[c]}
        end = next((c for c in way if c in free), None)
        queue = deque(way)
        while end is None and queue:
            x = queue.popleft()
            for y in (*free, *(c for c in turn if c not in free)):
                if y not in way and (p := passed(x, y, at)) is not None:
                    way[y] = (x, p)
                    queue.append(y)
                    if y in free:
                        end = y
                        break
        if end is None:
            raise ValueError(f"no deal without doubles: {e!r} occurs too often for the classes' sizes")
        hole = free[end].pop()
        if not free[end]:
            del free[end]
        while (step := way[end]) is not None:
            x, p = step
            f = classes[x][p]
            classes[end][hole] = f
            has[end].add(f)
            has[x].remove(f)
            end, hole = x, p
        classes[end][hole] = e
        has[end].add(e)


def _running(rows: DataFrame, by: list[str], order: list[str], amount: Column) -> DataFrame:
    """``rows`` with __sum: ``amount`` added up over each ``by`` in the order of the hash ``order[0]`` and the columns after it.

    Rows are added up inside 4096 ranges of the hash and the ranges' totals then, so no task goes through all rows of a ``by``.
    """
    ranged = rows.withColumn("__range", F.substring(order[0], 1, 3)).withColumn("__amount", amount)
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__amount").alias("__before"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__before").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__in", F.sum("__amount").over(inside)).join(totals, [*by, "__range"])
    return summed.withColumn("__sum", F.col("__in") + F.col("__before")).drop("__range", "__amount", "__in", "__before")


def random_candidates(candidates: DataFrame, num_random: int, seed: int = 0, spare: int = 2, by: list[str] | None = None) -> DataFrame:
    """replicate, cand, entities: the bag of all entities dealt anew to classes of the same sizes.

    The order is a hash of entity, class, place, replicate and seed, so a rerun
    gives the same classes. Deals in which a class holds an entity twice are
    ``repaired`` (each in one task, which holds its bag), so there are always
    ``num_random`` replicates; ``spare`` has no use any more and is kept for callers.
    """
    by = by or []
    spark = candidates.sparkSession
    ship_package(spark)
    one = F.lit(1).cast("long")
    tries = F.explode(F.sequence(F.lit(0), F.lit(num_random - 1))).alias("replicate")
    bag = candidates.select(*by, F.posexplode("entities").alias("place", "entity"), "cand")
    dealt = bag.select(*by, "entity", "place", "cand", tries).where(F.col("replicate").between(0, num_random - 1))
    dealt = dealt.withColumn("h", F.md5(F.concat_ws("|", "entity", "cand", "place", "replicate", F.lit(str(seed)))))
    dealt = _running(dealt, [*by, "replicate"], ["h", "entity", "cand", "place"], one).select(*by, "replicate", "entity", F.col("__sum").alias("at"))
    sized = candidates.where(F.size("entities") > 0).select(*by, "cand", F.size("entities").cast("long").alias("n"), F.md5(F.col("cand").cast("string")).alias("h"))
    bounds = _running(sized, by, ["h", "cand"], F.col("n"))
    slots = bounds.select(*by, "cand", F.explode(F.sequence(F.col("__sum") - F.col("n") + 1, F.col("__sum"))).alias("at"))
    # a slot for each entity, which Spark takes for as small as the table of classes it is exploded from: no broadcast
    placed = dealt.join(slots.hint("merge"), [*by, "at"]).groupBy(*by, "replicate", "cand").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    placed = materialize(placed, "deals")
    doubles = placed.where(F.size(F.array_distinct("entities")) < F.size("entities")).select(*by, "replicate").distinct()
    columns = [*by, "replicate", "cand", "entities"]

    def run(frame):
        frame = frame.sort_values("cand")
        lists = [list(e) for e in frame["entities"]]
        salt = f"{seed}:{frame['replicate'].iloc[0]}:"
        repaired(lists, lambda e: zlib.crc32(f"{salt}{e}".encode()))
        return frame.assign(entities=[sorted(e) for e in lists])

    good = placed.join(doubles, [*by, "replicate"], "left_anti").select(*columns)
    doubled = placed.join(doubles, [*by, "replicate"], "left_semi").select(*columns)
    return good.unionByName(doubled.groupBy(*by, "replicate").applyInPandas(run, doubled.schema))


def above_random(values: DataFrame, by: list[str], deviations: float = 2.0) -> DataFrame:
    """by, above: induced values over the random mean by more than so many population deviations.

    ``values``: by, value (nulls do not count), is_random. Without random values all induced ones count.
    """
    v = values.where("value is not null")
    stats = v.where("is_random").groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"))
    above = F.col("mean").isNull() | (F.col("value") - F.col("mean") > deviations * F.col("dev"))
    counted = v.where("not is_random").join(stats, by, "left").groupBy(*by).agg(F.count_if(above).alias("above"))
    return values.select(*by).distinct().join(counted, by, "left").withColumn("above", F.coalesce("above", F.lit(0).cast("long")))


def binned(values: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """by, is_random, n, x (mean of a bin's values), and of the whole group: lo, hi, induced, random (numbers of values),
    dev (sample deviation of random values), hole (whether an induced value is missing).

    Equal bins of the joint range, added up before anything moves, so a group has at most 2 ``bins`` rows.
    """
    of = values.groupBy(*by).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value").isNotNull() & ~F.col("is_random")).alias("induced"), F.count_if(F.col("value").isNotNull() & F.col("is_random")).alias("random"),
        F.stddev_samp(F.when(F.col("is_random"), F.col("value"))).alias("dev"), F.coalesce(F.bool_or(F.col("value").isNull() & ~F.col("is_random")), F.lit(False)).alias("hole"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = values.where("value is not null").join(of.select(*by, "lo", "hi"), by).withColumn("bin", at)
    cells = placed.groupBy(*by, "is_random", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("x"))
    return of.join(cells.drop("bin"), by, "left")


def _bins(frame) -> tuple:
    """(induced x, induced n, random x, random n, the group's values) of one group's bins."""
    parts = []
    for kind in (False, True):
        own = frame[frame["is_random"].fillna(not kind).astype(bool) == kind].sort_values("x")
        parts += [own["x"].to_numpy(float), own["n"].to_numpy(float)]
    return (*parts, frame.iloc[0])


def mean_tail(values: DataFrame, by: list[str]) -> DataFrame:
    """by, tail: mean over induced values of the random density's mass beyond them (one experiment per group), from BINS bins."""
    ship_package(values.sparkSession)

    def run(key, frame):
        import pandas as pd

        x, n, r, w, of = _bins(frame)
        tail = None
        if of["induced"] and of["random"] > 1 and of["dev"] > 0:
            lo = of["lo"] - (of["hi"] - of["lo"])
            tail = float(np.average(1 - kde_mass(r, lo, x, w, of["dev"]), weights=n))
        return pd.DataFrame([(*key, tail)], columns=[*by, "tail"])

    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in by)
    return binned(values, by).groupBy(*by).applyInPandas(run, f"{kinds}, tail double")


def divergence(values: DataFrame, by: list[str], points: int = 300) -> DataFrame:
    """by, kl: Kullback-Leibler divergence of the random density from the induced one on points + 1 points, from BINS bins;
    0 where the induced one has no density."""
    ship_package(values.sparkSession)

    def run(key, frame):
        import pandas as pd

        x, n, r, w, of = _bins(frame)
        kl = None
        if of["random"] > 1 and of["dev"] > 0:
            kl = 0.0
            if not of["hole"] and of["induced"] > 1 and len(x) > 1:
                width = of["hi"] - of["lo"]
                at = np.linspace(of["lo"] - width / 2, of["hi"] + width / 2, points + 1)
                dev = math.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n) * n.sum() / (n.sum() - 1))
                p, q = kde(r, at, w, of["dev"]), kde(x, at, n, dev)
                p, q = p / p.sum(), q / q.sum()
                with np.errstate(divide="ignore", invalid="ignore"):
                    terms = np.where(p > 0, p * np.log(p / q), 0.0)
                kl = float(terms.sum())
        return pd.DataFrame([(*key, kl)], columns=[*by, "kl"])

    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in by)
    return binned(values, by).groupBy(*by).applyInPandas(run, f"{kinds}, kl double")


def histogram(values: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """by, bin, lo, hi, n: induced values over equal bins of the joint range; the last bin is closed.

    Groups without induced or without random values give nothing.
    """
    v = values.where("value is not null")
    span = v.groupBy(*by).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count_if("is_random").alias("r"), F.count_if(~F.col("is_random")).alias("i")).where("r > 0 and i > 0")
    width = (F.col("most") - F.col("least")) / bins
    bin_ = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("value") - F.col("least")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = v.where("not is_random").join(span, by).withColumn("bin", bin_.cast("int"))
    return placed.groupBy(*by, "bin", "least", "most").agg(F.count("*").alias("n")).select(*by, "bin", (F.col("least") + F.col("bin") * width).alias("lo"), (F.col("least") + (F.col("bin") + 1) * width).alias("hi"), "n")
