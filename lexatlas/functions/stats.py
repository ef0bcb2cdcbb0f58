"""Numeric columns: binomial tails, cosine, kernel densities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Of numbers from 1 on, by Stirling's series ten places further."""
    y = x + 10
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return series - F.ln(product)


def binomial_tail(size: Column, share: Column, common: Column) -> Column:
    """Over- or under-representation of ``common`` hits among ``size`` draws at rate ``share``.

    P(X >= common) where common/size exceeds the rate, else -P(X <= common).
    The mass at ``common`` is computed by itself and carried outwards, where masses fall; 10 deviations and
    60 numbers on, what is left is below a double's precision (Bernstein), so the work grows with the deviation.
    """
    size, common = size.cast("double"), common.cast("double")
    p = share.cast("double")
    over = common / size > p
    mass = log_gamma(size + 1) - log_gamma(common + 1) - log_gamma(size - common + 1) + common * F.ln(p) + (size - common) * F.ln(1 - p)
    n = F.least(F.when(over, size - common).otherwise(common), F.ceil(10 * F.sqrt(size * p * (1 - p))) + 60).cast("int")

    def step(a: Column, i: Column) -> Column:
        up = (size - common - i + 1) / (common + i) * (p / (1 - p))
        down = (common - i + 1) / (size - common + i) * ((1 - p) / p)
        term = a["term"] * F.when(over, up).otherwise(down)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    further = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    inner = F.exp(mass) * F.aggregate(further, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step)["total"]
    edge = F.when(p <= 0, F.when(common == 0, 1.0).otherwise(0.0)).otherwise(F.when(common == size, 1.0).otherwise(0.0))
    tail = F.when((p <= 0) | (p >= 1), edge).otherwise(inner)
    return F.when(over, tail).otherwise(-tail)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def scott_bandwidth(dev: float, n: float) -> float:
    """From the sample deviation of n values."""
    return dev * n ** (-1 / 5)


def kde(x: np.ndarray, at: np.ndarray, weights: np.ndarray, dev: float) -> np.ndarray:
    """Gaussian kernel density with Scott's bandwidth of values ``x`` that occur ``weights`` times."""
    h = scott_bandwidth(dev, weights.sum())
    z = (at[:, None] - x[None, :]) / h
    return (np.exp(-z * z / 2) * weights).sum(1) / (weights.sum() * h * math.sqrt(2 * math.pi))


def kde_mass(x: np.ndarray, lo: float, hi: np.ndarray, weights: np.ndarray, dev: float) -> np.ndarray:
    """Mass of that density between lo and each of hi."""
    h = scott_bandwidth(dev, weights.sum()) * math.sqrt(2)
    erf = np.vectorize(math.erf, otypes=[float])
    inside = erf((hi[:, None] - x) / h) - erf((lo - x) / h)[None, :]
    return (inside * weights).sum(1) / (2 * weights.sum())
