"""Encoders, scalers and feature builders. ``fit`` runs one aggregate; ``transform`` is a projection."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation
from ..plans.ordering import picked
from ..sources.models import saveable

#: Categories that an encoder holds on the driver at most.
MAX_CATEGORIES = 100_000


def categories(df: DataFrame, column: str, order: str | Column | None = None) -> list:
    """Distinct values, in the order of their least ``order`` (first appearance) or else sorted."""
    by = F.min(order).alias("o") if order is not None else F.first(F.lit(0)).alias("o")
    rows = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(by).orderBy("o", "v").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    return [r["v"] for r in rows]


def _lookup(values: list, column: Column) -> Column:
    """The place of a value in a list by a literal map."""
    if not values:
        return F.lit(None).cast("int")
    pairs = F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.lit(i) for i in range(len(values))]))
    return F.try_element_at(pairs, column)


@saveable
@dataclass
class LabelEncoder:
    """Categories as numbers from 0. unknown: "error", "ignore" (NULL) or "extend" (numbers behind the known, by sort order)."""

    classes: list
    unknown: str = "error"

    @classmethod
    def fit(cls, df: DataFrame, column: str, order: str | Column | None = None, unknown: str = "error") -> LabelEncoder:
        """order: a column whose least value ranks a category (first appearance); default: sorted."""
        return cls(categories(df, column, order), unknown)

    def transform(self, df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        if self.unknown == "extend":
            new = [v for v in categories(df, column) if v not in set(self.classes)]
            self.classes = [*self.classes, *new]
        at = _lookup(self.classes, F.col(column))
        if self.unknown == "error":
            at = F.when(F.col(column).isNotNull() & at.isNull(), F.raise_error(F.concat(F.lit("unknown category: "), F.col(column).cast("string"))).cast("int")).otherwise(at)
        return df.withColumn(output or column, at)

    def inverse(self, df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        return df.withColumn(output or column, F.get(F.array(*[F.lit(v) for v in self.classes]), F.col(column).cast("int")))


@saveable
@dataclass
class OneHotEncoder:
    """An indicator column for each category; missing values give zeros everywhere, unknown ones too unless unknown is "error"."""

    classes: dict
    drop_first: bool = False
    prefix: bool = True
    unknown: str = "ignore"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], order: str | None = None, drop_first: bool = False, prefix: bool = True, unknown: str = "ignore") -> OneHotEncoder:
        return cls({c: categories(df, c, order) for c in columns}, drop_first, prefix, unknown)

    def _made(self) -> list[tuple[str, str, Any]]:
        return [(c, f"{c}_{v}" if self.prefix else str(v), v) for c, vs in self.classes.items() for v in vs[int(self.drop_first) :]]

    def names(self) -> list[str]:
        return [n for _, n, _ in self._made()]

    def transform(self, df: DataFrame, keep: bool = False) -> DataFrame:
        for c, vs in self.classes.items() if self.unknown == "error" else ():
            df = df.filter(F.when(F.col(c).isNotNull() & ~F.col(c).isin(vs), F.raise_error(F.concat(F.lit("unknown category: "), F.col(c).cast("string"))).cast("boolean")).otherwise(True))
        out = df.withColumns({n: F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for c, n, v in self._made()})
        return out if keep else out.drop(*self.classes)


@saveable
@dataclass
class Scaler:
    """x -> (x - shift) / scale + low, column by column."""

    columns: list
    shift: list
    scale: list
    low: float = 0.0

    @classmethod
    def standard(cls, df: DataFrame, columns: list[str]) -> Scaler:
        """Mean and population deviation; a constant column is only shifted."""
        r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        return cls(list(columns), [r[f"m{i}"] for i in range(len(columns))], [r[f"s{i}"] or 1.0 for i in range(len(columns))])

    @classmethod
    def minmax(cls, df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> Scaler:
        """Least to ``low`` and greatest to ``high``; a constant column becomes ``low``."""
        r = df.agg(*[F.min(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(c).cast("double").alias(f"b{i}") for i, c in enumerate(columns)]).first()
        return cls(list(columns), [r[f"a{i}"] for i in range(len(columns))], [((r[f"b{i}"] - r[f"a{i}"]) or 1.0) / (high - low) for i in range(len(columns))], float(low))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - float(m)) / float(s) + self.low for c, m, s in zip(self.columns, self.shift, self.scale)})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.low) * float(s) + float(m) for c, m, s in zip(self.columns, self.shift, self.scale)})


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2, bias: bool = False, only: bool = True) -> DataFrame:
    """All products of up to ``degree`` columns with repetition, by degree: a, b, a^2, a*b, b^2."""
    made: dict[str, Column] = {"bias": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for pick in combinations_with_replacement(columns, d):
            parts = [(c, pick.count(c)) for c in dict.fromkeys(pick)]
            value = F.lit(1.0)
            for c in pick:
                value = value * F.col(c)
            made["*".join(c if k == 1 else f"{c}^{k}" for c, k in parts)] = F.col(c).cast("double") if d == 1 else value
    return df.select(*[v.alias(k) for k, v in made.items()]) if only else df.withColumns(made)


def powers(df: DataFrame, column: str, degree: int, first: int = 2) -> DataFrame:
    """column^first to column^degree beside the other columns."""
    return df.withColumns({f"{column}^{k}": F.pow(F.col(column).cast("double"), F.lit(float(k))) for k in range(first, degree + 1)})


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    """The product of each pair, NULL if either is missing."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})


@saveable
@dataclass
class EqualWidthBins:
    column: str
    low: float
    high: float
    bins: int = 5

    @classmethod
    def fit(cls, df: DataFrame, column: str, bins: int = 5) -> EqualWidthBins:
        r = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).first()
        return cls(column, r["a"], r["b"], bins)

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        """bin_1 to bin_n; values outside the fitted range go to the first or last."""
        step = (self.high - self.low) / self.bins
        at = F.floor((F.col(self.column) - self.low) / step) + 1 if step else F.lit(1)
        label = F.concat(F.lit("bin_"), F.greatest(F.lit(1), F.least(F.lit(self.bins), at)).cast("string"))
        return df.withColumn(output or self.column, F.when(F.col(self.column).isNotNull(), label))


@saveable
@dataclass
class Clipper:
    """Values outside q1 - factor iqr and q3 + factor iqr are moved to the edge."""

    low: dict
    high: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], factor: float = 1.5) -> Clipper:
        low, high = {}, {}
        for c in columns:
            n = df.filter(F.col(c).isNotNull()).count()
            q1, q3 = picked(df, c, [int(n * 0.25), int(n * 0.75)])  # the values at these places, not interpolated
            low[c], high[c] = float(q1 - factor * (q3 - q1)), float(q3 + factor * (q3 - q1))
        return cls(low, high)

    def transform(self, df: DataFrame) -> DataFrame:
        clip = {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(self.low[c]), F.least(F.lit(self.high[c]), F.col(c).cast("double")))) for c in self.low}
        return df.withColumns(clip)


def varying(df: DataFrame, columns: list[str], threshold: float = 0.0) -> list[str]:
    """Columns whose population variance is above the threshold, or that have no value at all."""
    r = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[f"v{i}"] is None or r[f"v{i}"] > threshold]


def uncorrelated(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Columns left when the later one of each pair with a larger absolute correlation goes."""
    pairs = list(combinations(range(len(columns)), 2))
    r = df.agg(*[correlation(F.col(columns[i]), F.col(columns[j])).alias(f"r{k}") for k, (i, j) in enumerate(pairs)]).first() if pairs else []
    gone: set[int] = set()
    for k, (i, j) in enumerate(pairs):
        if i not in gone and j not in gone and r[k] is not None and abs(r[k]) > threshold:
            gone.add(j)
    return [c for i, c in enumerate(columns) if i not in gone]


# Compositions as columns of parts.
def multiplicative_replacement(df: DataFrame, parts: list[str], delta: float = 1e-6) -> DataFrame:
    """Zeros become delta, other parts give it up in equal shares, then closure."""
    zeros = sum((F.coalesce(F.col(c), F.lit(0.0)) == 0).cast("int") for c in parts)
    raw = {c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(delta)).otherwise(F.col(c) - delta * zeros / F.nullif(F.lit(len(parts)) - zeros, F.lit(0))) for c in parts}
    out = df.withColumns({f"__{c}": v for c, v in raw.items()})
    whole = sum(F.col(f"__{c}") for c in parts)
    return out.withColumns({c: F.col(f"__{c}") / whole for c in parts}).drop(*[f"__{c}" for c in parts])


def centered_composition(df: DataFrame, parts: list[str]) -> DataFrame:
    """Every cell over the geometric mean of all cells, then closure."""
    r = df.agg(*[F.avg(F.log(F.col(c))).alias(c) for c in parts]).first()
    g = float(np.exp(np.mean([r[c] for c in parts])))
    whole = sum(F.col(c) / g for c in parts)
    return df.withColumns({c: F.col(c) / g / whole for c in parts})


# Splines.
def knots(df: DataFrame, column: str, n: int, kind: str = "quantile") -> list[float]:
    """Inner knots: the values at the places floor(q (rows - 1)), q = i / (n + 1), or evenly spaced."""
    if kind == "uniform":
        r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
        return [r["a"] + (r["b"] - r["a"]) * i / (n + 1) for i in range(1, n + 1)]
    rows = df.filter(F.col(column).isNotNull()).count()
    return [float(v) for v in picked(df, column, [int(i / (n + 1) * (rows - 1)) for i in range(1, n + 1)])]


def truncated_power_basis(x: Column, at: list[float]) -> list[Column]:
    """x, then (x - k)^3 where positive for each knot."""
    return [x.cast("double"), *[F.pow(F.greatest(x - float(k), F.lit(0.0)), F.lit(3.0)) for k in at]]


def cubic_regression_basis(x: Column, at: list[float]) -> list[Column]:
    return [F.lit(1.0), *truncated_power_basis(x, at)]


def bspline_basis(x: Column, at: list[float], low: float, high: float, degree: int = 3, derivative: int = 0) -> list[Column]:
    """B-splines by the Cox-de Boor recursion, unrolled into expressions; x is clamped just inside the ends."""
    edge = 1e-5
    t = [low - edge] * (degree + 1) + [float(k) for k in at] + [high + edge] * (degree + 1)
    x = F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double")))

    def basis(d: int) -> list[Column]:
        b = [((x >= t[i]) & (x < t[i + 1])).cast("double") if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
        for k in range(1, d + 1):
            b = [
                (b[i] * ((x - t[i]) / (t[i + k] - t[i])) if t[i + k] > t[i] else F.lit(0.0)) + (b[i + 1] * ((t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1])) if t[i + k + 1] > t[i + 1] else F.lit(0.0))
                for i in range(len(b) - 1)
            ]
        return b

    if not derivative:
        return basis(degree)
    b = basis(degree - 1)
    return [
        (b[i] * (degree / (t[i + degree] - t[i])) if t[i + degree] > t[i] else F.lit(0.0)) - (b[i + 1] * (degree / (t[i + degree + 1] - t[i + 1])) if t[i + degree + 1] > t[i + 1] else F.lit(0.0))
        for i in range(len(b) - 1)
    ]


def penalty(n: int, order: int = 2) -> np.ndarray:
    """D'D of the differences of an order between neighbouring coefficients."""
    d = np.diff(np.eye(n), order, axis=0)
    return d.T @ d
