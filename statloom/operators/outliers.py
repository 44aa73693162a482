"""Outlier detectors. Labels: 1 inlier, -1 outlier; rows with a missing value are inliers."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chisq_cdf
from ..plans.gram import gram
from ..plans.ordering import picked
from ..sources.models import saveable
from ..sources.tables import normalize, settled
from .neighbors import HELD, neighbors


def quadratic_form(columns: list[Column], center: np.ndarray, precision: np.ndarray) -> Column:
    """(x - c)' P (x - c)."""
    d = [c.cast("double") - float(m) for c, m in zip(columns, center)]
    out = F.lit(0.0)
    for i, a in enumerate(d):
        for j in range(i, len(d)):
            out = out + a * d[j] * float(precision[i, j] * (1 if i == j else 2))
    return out


def label_at(df: DataFrame, score: str, threshold: float, output: str = "outlier") -> DataFrame:
    return df.withColumn(output, F.when(F.col(score) >= threshold, -1).otherwise(1))


@saveable
@dataclass
class Mahalanobis:
    """Distance from the mean in units of the covariance; the farthest share ``contamination`` are outliers."""

    columns: list
    center: np.ndarray
    precision: np.ndarray
    threshold: float

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], contamination: float = 0.1) -> Mahalanobis:
        df = normalize(df)
        g = gram(df, columns)
        m = cls(list(columns), g.mean, np.linalg.pinv(g.covariance()), math.inf)
        n = int(g.n)
        if out := int(n * contamination):
            scored = m.score(df.dropna(subset=columns))
            m.threshold = float(picked(scored, "distance", [n - out])[0])
        return m

    def score(self, df: DataFrame, output: str = "distance") -> DataFrame:
        q = quadratic_form([F.col(c) for c in self.columns], self.center, self.precision)
        return df.withColumn(output, F.sqrt(F.greatest(q, F.lit(0.0))))

    def label(self, df: DataFrame, output: str = "outlier") -> DataFrame:
        return label_at(self.score(normalize(df), "__d"), "__d", self.threshold, output).drop("__d")


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Random trees on samples of at most ``max_samples`` rows; score 2^(-mean depth / expected depth).

    The sample for all trees is the rows with the smallest hashes: trees x max_samples rows on the driver.
    """

    columns: list[str]
    trees: list
    size: int
    threshold: float

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], key: str, n_estimators: int = 100, max_samples: int = 256, contamination: float = 0.1, seed: int = 42, threshold_accuracy: int = 10_000) -> IsolationForest:
        rows = normalize(df).dropna(subset=columns)
        pool = rows.select(*[F.col(c).cast("double") for c in columns]).orderBy(F.xxhash64(F.lit(seed), key), key).limit(n_estimators * max_samples)
        x, rng = pool.toPandas().to_numpy(float), np.random.default_rng(seed)
        size = min(max_samples, len(x))
        limit = math.ceil(math.log2(max(size, 2)))

        def grow(at: np.ndarray, depth: int):
            if depth >= limit or len(at) <= 1:
                return (-1, depth + average_path(len(at)), None, None)
            part = x[at]
            wide = np.flatnonzero(part.max(0) > part.min(0))
            if not len(wide):
                return (-1, depth + average_path(len(at)), None, None)
            f = int(rng.choice(wide))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            left = part[:, f] < cut
            return (f, cut, grow(at[left], depth + 1), grow(at[~left], depth + 1))

        trees = [grow(rng.choice(len(x), size, replace=False), 0) for _ in range(n_estimators)] if len(x) else []
        model = cls(list(columns), trees, size, math.inf)
        if trees and contamination > 0:
            model.threshold = float(model.score(rows).agg(F.percentile_approx("score", 1 - contamination, threshold_accuracy)).first()[0])
        return model

    def score(self, df: DataFrame, output: str = "score") -> DataFrame:
        told = df.sparkSession.sparkContext.broadcast((self.trees, average_path(self.size) or 1.0))

        @F.pandas_udf("double")
        def scores(*series):
            import pandas as pd

            x = np.column_stack([s.to_numpy(float) for s in series])
            trees, scale = told.value
            total = np.zeros(len(x))

            def walk(node, at):
                f, v, left, right = node
                if f < 0:
                    total[at] += v
                    return
                go = x[at, f] < v
                walk(left, at[go])
                walk(right, at[~go])

            for t in trees:
                walk(t, np.arange(len(x)))
            out = 2.0 ** (-total / max(len(trees), 1) / scale)
            return pd.Series(np.where(np.isnan(x).any(1), np.nan, out))

        return normalize(df.withColumn(output, scores(*[F.col(c).cast("double") for c in self.columns])))

    def label(self, df: DataFrame, output: str = "outlier") -> DataFrame:
        return label_at(self.score(df, "__s"), "__s", self.threshold, output).drop("__s")


def local_outlier_factor(df: DataFrame, columns: list[str], key: str, k: int = 20, contamination: float = 0.1, metric: str = "euclidean", held: int = HELD) -> DataFrame:
    """``df``'s key, lof and outlier, for a table of any size: neighbours come from ``neighbors``, by shards beyond ``held`` rows.

    k-distance, reachability, density and factor are joins over the k-neighbour table.
    """
    rows = normalize(df).dropna(subset=columns)
    near = settled(neighbors(rows, rows, columns, key, key, k, metric, exclude_self=True, held=held).select("query", "neighbor", "distance"))
    kdist = near.groupBy(F.col("query").alias("neighbor")).agg(F.max("distance").alias("kdist"))
    reach = near.join(kdist, "neighbor").withColumn("reach", F.greatest("distance", "kdist"))
    density = reach.groupBy("query").agg(F.try_divide(F.lit(1.0), F.avg("reach")).alias("lrd"))
    other = density.select(F.col("query").alias("neighbor"), F.col("lrd").alias("other"))
    factor = near.join(other, "neighbor").join(density, "query").groupBy("query").agg(F.coalesce(F.avg(F.try_divide(F.col("other"), F.col("lrd"))), F.lit(1.0)).alias("lof"))
    n = factor.count()
    out = int(n * contamination)
    threshold = picked(factor, "lof", [n - out])[0] if out else math.inf
    return label_at(factor.withColumnRenamed("query", key), "lof", float(threshold))


def write_labels(df: DataFrame, labels: DataFrame, key: str, output: str = "outlier") -> DataFrame:
    """``df`` with labels put in by key; rows without one are inliers."""
    return df.join(labels.select(key, F.col(output).alias("__l")), key, "left").withColumn(output, F.coalesce("__l", F.lit(1))).drop("__l")


@saveable
@dataclass
class CompositionalOutliers:
    """Squared Mahalanobis distance of log-ratio coordinates, with chi-square p-values on D - 1 degrees of freedom."""

    parts: list
    center: np.ndarray
    precision: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, parts: list[str], reference: Column | None = None) -> CompositionalOutliers:
        """reference: rows to learn from; default all."""
        rows = df if reference is None else df.filter(reference)
        g = gram(rows, cls._clr(parts))
        return cls(list(parts), g.mean, np.linalg.pinv(g.covariance(), rcond=1e-10))

    @staticmethod
    def _clr(parts: list[str]) -> dict[str, Column]:
        mean = sum((F.log(F.col(p).cast("double")) for p in parts), F.lit(0.0)) / len(parts)
        return {p: F.log(F.col(p).cast("double")) - mean for p in parts}

    def score(self, df: DataFrame, alpha: float = 0.025) -> DataFrame:
        """``df`` with d2, p_value and outlier (p_value < alpha)."""
        d = len(self.parts) - 1

        @F.pandas_udf("double")
        def tail(x):
            return x.map(lambda v: None if v != v else 1 - chisq_cdf(v, d))

        out = df.withColumn("d2", quadratic_form(list(self._clr(self.parts).values()), self.center, self.precision))
        return out.withColumn("p_value", tail("d2")).withColumn("outlier", F.col("p_value") < alpha)
