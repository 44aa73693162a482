"""Descriptive aggregates. One pass each; approximate quantiles are there for tables too large for exact ones."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation
from ..plans.gram import gram
from ..plans.ordering import picked


def finite(c: str | Column, na_omit: bool = True) -> Column:
    """The column without NaN and infinities; or an error for them."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    bad = F.isnan(c) | (F.abs(c) == math.inf)
    return F.when(~bad, c) if na_omit else F.when(bad, F.raise_error(F.lit("not a finite number")).cast("double")).otherwise(c)


def variance(c, sample: bool = True) -> Column:
    return F.var_samp(finite(c)) if sample else F.var_pop(finite(c))


def stddev(c, sample: bool = True) -> Column:
    return F.stddev_samp(finite(c)) if sample else F.stddev_pop(finite(c))


sd = std = stddev


def quantile(c, p: float | list[float], approximate: int | None = None) -> Column:
    """Linearly interpolated quantile (type 7); approximate: a rank accuracy, for a sketch of bounded size."""
    ps = p if isinstance(p, list) else [p]
    if any(not 0 <= q <= 1 for q in ps):
        raise ValueError("a probability lies between 0 and 1")
    at = F.array(*[F.lit(float(q)) for q in ps]) if isinstance(p, list) else F.lit(float(p))
    return F.percentile_approx(finite(c), p, approximate) if approximate else F.percentile(finite(c), at)


def nearest_quantile(df: DataFrame, column: str, p: float) -> float:
    """The value at the place nearest to p (n - 1); halves go down."""
    n = df.filter(F.col(column).isNotNull()).count()
    at = p * (n - 1)
    return picked(df, column, [math.ceil(at) if at - math.floor(at) > 0.5 else math.floor(at)])[0]


def median(c) -> Column:
    return F.median(finite(c))


def ecdf(c, value: float) -> Column:
    """Share of values up to ``value``."""
    return F.avg((finite(c) <= value).cast("double"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, mean, sd, variance, least, quartiles, greatest."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("value")) for c in columns])).alias("r")).select("r.*")
    v = F.col("value")
    q = F.percentile(v, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = stacked.groupBy("column").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("variance"), q.alias("q"))
    return out.select("column", "n", "mean", "sd", "variance", *[F.col("q")[i].alias(k) for i, k in enumerate(("min", "q1", "median", "q3", "max"))])


def covariance_matrix(df: DataFrame, columns: list[str], center: bool = True) -> np.ndarray:
    g = gram(df, columns)
    return g.covariance() if center else g.g / (g.n - 1)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations; 0 with a constant column, 1 on the diagonal."""
    c = gram(df, columns).covariance()
    s = np.sqrt(np.maximum(np.diag(c), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where(np.outer(s, s) > 0, c / np.outer(s, s), 0.0)
    np.fill_diagonal(r, 1.0)
    return r


def correlation_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """The correlation matrix in long form: a, b, r."""
    pairs = [(a, b) for a in columns for b in columns]
    r = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if a == b else F.coalesce(F.col(f"r{i}"), F.lit(0.0))).alias("r")) for i, (a, b) in enumerate(pairs)])
    return r.select(F.inline(cells))


# Impurities of a node.
def class_shares(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))  # totals: a single row
    return joined.select(*by, y, "n", "total", (F.col("n") / F.col("total")).alias("p"))


def impurity(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    """gini, entropy (base 2) and classification error of the classes of ``y``."""
    p = F.col("p")
    return class_shares(df, y, by).groupBy(*(by or [])).agg((1 - F.sum(p * p)).alias("gini"), (-F.sum(p * F.log2(p))).alias("entropy"), (1 - F.max(p)).alias("error"))


def absolute_impurity(df: DataFrame, y: str) -> float:
    """Mean absolute distance from the upper median."""
    n = df.filter(F.col(y).isNotNull()).count()
    m = picked(df, y, [n // 2])[0] if n else 0.0
    return df.agg(F.avg(F.abs(F.col(y) - float(m)))).first()[0] or 0.0


CRITERIA = ("gini", "entropy", "error", "variance")


def information_gain(df: DataFrame, y: str, side: Column, criterion: str = "gini") -> float:
    """Impurity of all rows less the weighted impurity of the sides of a split."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}")
    rows = df.select(F.col(y).alias("y"), side.alias("side"))
    if criterion == "variance":
        r = rows.groupBy("side").agg(F.count("y").alias("n"), F.sum(F.col("y").cast("double")).alias("s"), F.sum(F.col("y").cast("double") * F.col("y")).alias("q")).collect()
        n, s, q = (sum(x[k] for x in r) for k in "nsq")
        return q / n - (s / n) ** 2 - sum(x["q"] - x["s"] ** 2 / x["n"] for x in r) / n
    counts = rows.groupBy("side", "y").agg(F.count(F.lit(1)).alias("n")).collect()

    def of(c: list[int]) -> float:
        p = np.array([x for x in c if x], float)
        p /= p.sum()
        return float({"gini": 1 - (p * p).sum(), "entropy": -(p * np.log2(p)).sum(), "error": 1 - p.max()}[criterion])

    whole: dict = {}
    parts: dict = {}
    for r in counts:
        whole[r["y"]] = whole.get(r["y"], 0) + r["n"]
        parts.setdefault(r["side"], []).append(r["n"])
    n = sum(whole.values())
    return of(list(whole.values())) - sum(sum(c) / n * of(c) for c in parts.values())


def mode(df: DataFrame, column: str, order: str) -> DataFrame:
    """The most frequent value; of equals the one whose last row comes first, as a count in row order reaches the top with it."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
    return counts.orderBy(F.desc("n"), "last").limit(1).select(F.col(column).alias("mode"), "n")
