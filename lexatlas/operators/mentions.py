"""Entity mentions: runs of tagged tokens with their context, by array functions inside one row.

A corpus is one row of token arrays, so extraction is a projection and an
explode: no window, no shuffle, and corpora never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions.text import is_blank

#: Tag heads outside of any entity.
OUTSIDE = ('"', "NE", "O")


def _once(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """``rows`` with array columns computed once: a generator keeps the optimiser from copying their
    expressions into every lambda that indexes them."""
    return rows.select(*keys, F.inline(F.array(F.struct(*arrays))))


def extract_mentions(arrays: DataFrame, key: str = "doc_id", width: int = 25) -> DataFrame:
    """key, ne, tag, context, start, end, first_idx, close_idx of every mention.

    ``arrays`` has key, forms (array of strings) and tags (array of string
    arrays). A run of tokens whose tag head is not in OUTSIDE is one mention,
    whatever its prefixes; blank forms in it are skipped; a run that no outside
    token closes is dropped. The context takes ``width`` tokens on each side,
    the closing token included; offsets are half-open code points.
    """
    last = F.size("forms") - 1
    outside = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(F.get("tags", i), F.lit(0)).isin(*OUTSIDE))
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), F.slice("o", 1, F.greatest(F.size("o") - 1, F.lit(0)))), F.col("o"), lambda a, b: F.struct(a.alias("a"), b.alias("i")))
    rows = _once(_once(arrays.where(F.size("forms") > 0), [key], ["forms", "tags"]).withColumn("o", outside), [key], ["forms", "tags", "o"]).where(F.size("o") > 0)
    runs = rows.select(key, "forms", "tags", F.explode(F.filter(gaps, lambda g: g["i"] - g["a"] > 1)).alias("g"))
    filled = F.filter(F.sequence(F.col("g.a") + 1, F.col("g.i") - 1), lambda j: ~is_blank(F.col("forms")[j]))
    runs = runs.withColumn("w", filled).where(F.size("w") > 0)
    i, n = F.col("g.i"), F.size("w")
    take = lambda lo, hi: F.array_join(F.slice("forms", lo + 1, F.greatest(hi - lo, F.lit(0))), " ")
    before = take(F.greatest(F.lit(0), i - width - n), i - n)
    after = take(i, F.least(i + width, F.size("forms")))
    tag = F.get(F.col("tags")[F.element_at("w", -1)], F.lit(1))
    parts = runs.select(key, F.array_join(F.transform("w", lambda j: F.col("forms")[j]), " ").alias("ne"), tag.alias("tag"), before.alias("before"), after.alias("after"), F.col("w")[0].alias("first_idx"), i.alias("close_idx"))
    start = F.length("before") + 1
    return parts.select(key, "ne", "tag", F.concat_ws(" ", "before", "ne", "after").alias("context"), start.alias("start"), (start + F.length("ne")).alias("end"), "first_idx", "close_idx")


def find_target(contexts: DataFrame, target: str, text: str = "context") -> DataFrame:
    """``contexts`` with start and end of the first match of the pattern ``target``, in any case.

    Contexts without a match have nulls; ``require_targets`` refuses them.
    """
    pattern = F.lit(f"(?i){target}")
    at = F.regexp_instr(F.col(text), pattern)
    size = F.length(F.regexp_substr(F.col(text), pattern))
    return contexts.withColumn("start", F.when(at > 0, at - 1)).withColumn("end", F.when(at > 0, at - 1 + size))


def require_targets(found: DataFrame) -> DataFrame:
    """Raise for the first context without a target."""
    missing = F.raise_error(F.lit("target not found in context"))
    return found.withColumn("start", F.when(F.col("start").isNull(), missing.cast("int")).otherwise(F.col("start")))


def crop(tokens: Column, target: Column, limit: int = 300) -> tuple[Column, Column]:
    """(tokens, target index) cut to ``limit`` tokens around the target; shorter ones stay."""
    half = limit // 2
    n = F.size(tokens)
    lo = F.greatest(F.lit(0), target - half)
    hi = F.least(n, target + half)
    return F.when(n > limit, F.slice(tokens, lo + 1, hi - lo)).otherwise(tokens), F.when(n > limit, target - lo).otherwise(target)


def group_mentions(mentions: DataFrame, by: str, order: str = "mention_id", first: int = 50) -> DataFrame:
    """by, n, lowest and highest id, and mentions: the ``first`` ids in order (what senses are induced from)."""
    all_ = mentions.groupBy(by).agg(F.count("*").alias("n"), F.min(order).alias("lowest"), F.max(order).alias("highest"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    listed = mentions.select(by, order).withColumn("r", rank).where(F.col("r") <= first).groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("mentions"))
    return all_.join(listed, by)
