"""Equi-joins in which a few keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are broadcast, and the fewest rows of such a key.
MAX_KEYS, LEAST_ROWS = 10_000, 1000


def join_uneven(rows: DataFrame, side: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key and tells how many rows have it (``copies``).

    Keys with a share of 1 / MAX_KEYS or more of the rows, so at most MAX_KEYS, are
    broadcast and their rows stay where they are; the others are shuffled.
    """
    total = side.agg(F.sum(copies)).first()[0] or 0
    least = max(LEAST_ROWS, -(-total // MAX_KEYS))
    hot = side.where(F.col(copies) >= least)
    even = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(copies) < least), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(even)
