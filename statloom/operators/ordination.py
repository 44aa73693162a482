"""Ordination: every method needs sums and cross-products only, so a fit is one aggregate and scores are arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.gram import Gram, gram, gram_by
from ..sources.models import saveable
from ..sources.tables import normalize, settled


def signed(v: np.ndarray) -> np.ndarray:
    """Axes (columns) turned so that their largest loading is positive."""
    top = np.abs(v).argmax(0)
    s = np.sign(v[top, np.arange(v.shape[1])])
    return v * np.where(s == 0, 1, s)


def scaling_of(kind) -> int:
    """1 if asked for, else 2."""
    return 1 if kind in (1, "1") else 2


def projected(columns: list[str], center, scale, axes: np.ndarray) -> list[Column]:
    out = []
    for j in range(axes.shape[1]):
        v = F.lit(0.0)
        for c, m, s, w in zip(columns, center, scale, axes[:, j]):
            v = v + (F.col(c).cast("double") - float(m)) * float(w / s)
        out.append(v)
    return out


def _moments(g: Gram, scale: bool, ddof: int = 0) -> tuple[np.ndarray, np.ndarray]:
    var = np.diag(g.covariance(ddof))
    s = np.sqrt(np.maximum(var, 0)) if scale else np.ones(len(var))
    return g.mean, np.where(s > 0, s, 1.0)


@saveable
@dataclass
class PCA:
    """Principal components: eigenvalues on n - 1; scores are left singular vectors (scaling 2) or times the singular values (1)."""

    columns: list
    center: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    n: float

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], scale: bool = False, components: int | None = None) -> PCA:
        g = gram(normalize(df), columns)
        center, s = _moments(g, scale)
        values, axes = np.linalg.eigh(g.covariance(1) / np.outer(s, s))
        order = np.argsort(-values)[:components]
        return cls(list(columns), center, s, signed(axes[:, order]), np.maximum(values[order], 0), g.n)

    @property
    def explained(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total else self.eigenvalues

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.explained)

    def loadings(self, scaling: int = 2) -> np.ndarray:
        return self.axes * np.sqrt(self.eigenvalues) if scaling_of(scaling) == 2 else self.axes

    def transform(self, df: DataFrame, scaling: int = 1, prefix: str = "PC", components: int | None = None) -> DataFrame:
        k = components or self.axes.shape[1]
        scores = projected(self.columns, self.center, self.scale, self.axes[:, :k])
        if scaling_of(scaling) == 2:
            s = np.sqrt(self.eigenvalues * (self.n - 1))
            scores = [c / float(v) if v else F.lit(0.0) for c, v in zip(scores, s)]
        return df.withColumns({f"{prefix}{i + 1}": c for i, c in enumerate(scores)})


@saveable
@dataclass
class LDA:
    """Linear discriminants: within-class covariance whitened, class means' axes; a row goes to the nearest class mean."""

    columns: list
    classes: list
    priors: np.ndarray
    center: np.ndarray
    means: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], y: str, components: int | None = None) -> LDA:
        parts = gram_by(normalize(df).filter(F.col(y).isNotNull()), y, columns)
        classes = sorted(parts)
        n = sum(g.n for g in parts.values())
        within = sum(g.g - np.outer(g.s, g.s) / g.n for g in parts.values()) / (n - len(classes))
        means, priors = np.array([parts[c].mean for c in classes]), np.array([parts[c].n / n for c in classes])
        center = priors @ means
        between = (means - center).T @ ((means - center) * priors[:, None])
        values, vectors = np.linalg.eigh(within)
        keep = values > values.max() * 1e-10
        white = vectors[:, keep] / np.sqrt(values[keep])
        lam, rot = np.linalg.eigh(white.T @ between @ white)
        k = min(components or len(columns), len(classes) - 1, int(keep.sum()))
        order = np.argsort(-lam)[:k]
        return cls(list(columns), classes, priors, center, means, signed(white @ rot[:, order]), np.maximum(lam[order], 0))

    def transform(self, df: DataFrame, prefix: str = "LD") -> DataFrame:
        made = projected(self.columns, self.center, np.ones(len(self.columns)), self.axes)
        return df.withColumns({f"{prefix}{i + 1}": c for i, c in enumerate(made)})

    def predict(self, df: DataFrame, output: str = "prediction", priors: bool = False) -> DataFrame:
        out = self.transform(df, "__ld")
        at = (self.means - self.center) @ self.axes
        scored = []
        for k, c in enumerate(self.classes):
            d = F.lit(0.0)
            for j in range(at.shape[1]):
                d = d + (F.col(f"__ld{j + 1}") - float(at[k, j])) * (F.col(f"__ld{j + 1}") - float(at[k, j]))
            scored.append(F.struct((d - (2 * math.log(self.priors[k]) if priors else 0.0)).alias("d"), F.lit(k).alias("k"), F.lit(c).alias("c")))
        return out.withColumn(output, F.least(*scored)["c"] if len(scored) > 1 else F.lit(self.classes[0])).drop(*[f"__ld{j + 1}" for j in range(at.shape[1])])


@saveable
@dataclass
class RDA:
    """Redundancy analysis: principal components of the responses' fitted values (constrained) and of the rest."""

    y: list
    x: list
    y_center: np.ndarray
    y_scale: np.ndarray
    x_center: np.ndarray
    coefficients: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    residual_axes: np.ndarray
    residual_eigenvalues: np.ndarray
    constrained: float
    statistic: float
    rank: int
    n: float

    @classmethod
    def fit(cls, df: DataFrame, y: list[str], x: list[str], scale: bool = False) -> RDA:
        return cls.of(gram(normalize(df), [*y, *x]), y, x, scale)

    @classmethod
    def of(cls, g: Gram, y: list[str], x: list[str], scale: bool = False) -> RDA:
        p = len(y)
        center, s = _moments(g, scale)
        s = np.concatenate((s[:p], np.ones(len(x))))
        cov = g.covariance(1) / np.outer(s, s)
        syy, sxy, sxx = cov[:p, :p], cov[p:, :p], cov[p:, p:]
        b = np.linalg.pinv(sxx, rcond=1e-10) @ sxy
        fitted = b.T @ sxx @ b
        rank = int(np.linalg.matrix_rank(sxx, tol=1e-10 * np.abs(sxx).max() if sxx.size else None))
        lam, axes = np.linalg.eigh(fitted)
        order = np.argsort(-lam)[: max(1, min(p, rank))]
        rest, rest_axes = np.linalg.eigh(syy - fitted)
        rest_order = np.argsort(-rest)
        total, explained = np.trace(syy), np.trace(fitted)
        df2 = g.n - rank - 1
        f = (explained / rank) / ((total - explained) / df2) if rank and df2 > 0 and total - explained > 1e-12 * total else math.inf
        return cls(list(y), list(x), center[:p], s[:p], center[p:], b, signed(axes[:, order]), np.maximum(lam[order], 0), signed(rest_axes[:, rest_order]), np.maximum(rest[rest_order], 0), float(explained / total) if total else 0.0, float(f), rank, g.n)

    def transform(self, df: DataFrame, prefix: str = "RDA") -> DataFrame:
        """Fitted (linear-combination) site scores from the explanatory columns."""
        made = projected(self.x, self.x_center, np.ones(len(self.x)), self.coefficients @ self.axes)
        return df.withColumns({f"{prefix}{i + 1}": c for i, c in enumerate(made)})


def rda_permutations(df: DataFrame, y: list[str], x: list[str], key: str, permutations: int = 199, seed: int = 42, block: int = 50) -> dict:
    """Permutation test of the pseudo-F: p = (as large or larger + 1) / (permutations + 1).

    A permutation pairs the rows' x in the order of the key with their y in the order of a hash; only the
    cross-products x'y change. A block of permutations is one order, one join and one aggregate.
    """
    from ..plans.ordering import indexed

    rows = settled(normalize(df).select(key, *[F.col(c).cast("double").alias(c) for c in (*y, *x)]).dropna())
    g = gram(rows, [*y, *x])
    observed, n = RDA.of(g, y, x).statistic, int(g.n)
    base = settled(indexed(rows.select(key, *x), [key], "__at").drop(key))
    p, larger = len(y), 0
    for first in range(0, permutations, block):
        many = rows.select(key, *[F.col(c).alias(f"__y{j}") for j, c in enumerate(y)]).withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(min(block, permutations - first) - 1))))
        many = many.withColumn("__hash", F.xxhash64(F.lit(seed + first) + F.col("__turn"), key))
        placed = indexed(many, ["__turn", "__hash", key], "__at").withColumn("__at", F.col("__at") - F.col("__turn") * n)
        cells = [F.sum(F.col(a) * F.col(f"__y{j}")).alias(f"s{k}_{j}") for k, a in enumerate(x) for j in range(p)]
        for sums in placed.join(base, "__at").groupBy("__turn").agg(*cells).collect():
            m = g.g.copy()
            for k in range(len(x)):
                for j in range(p):
                    m[p + k, j] = m[j, p + k] = sums[f"s{k}_{j}"]
            larger += RDA.of(Gram(g.names, g.n, g.s, m), y, x).statistic >= observed - 1e-12
    return {"statistic": observed, "p_value": (larger + 1) / (permutations + 1), "permutations": permutations}


@saveable
@dataclass
class CCA:
    """Canonical correlations of two sets of columns, with weights for unit-variance variates."""

    x: list
    y: list
    x_center: np.ndarray
    y_center: np.ndarray
    x_weights: np.ndarray
    y_weights: np.ndarray
    correlations: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, x: list[str], y: list[str], ridge: float = 0.0) -> CCA:
        g = gram(normalize(df), [*x, *y])
        p, c = len(x), g.covariance(1)
        rx, ry = (cls._root(m + ridge * np.eye(len(m))) for m in (c[:p, :p], c[p:, p:]))
        u, s, vt = np.linalg.svd(rx @ c[:p, p:] @ ry)
        k = min(p, len(y))
        a, b = rx @ u[:, :k], ry @ vt[:k].T
        top = np.abs(a).argmax(0)
        sign = np.where(a[top, np.arange(k)] < 0, -1, 1)
        return cls(list(x), list(y), g.mean[:p], g.mean[p:], a * sign, b * sign, np.clip(s[:k], 0, 1))

    @staticmethod
    def _root(m: np.ndarray) -> np.ndarray:
        v, e = np.linalg.eigh(m)
        keep = v > v.max() * 1e-12
        return (e[:, keep] / np.sqrt(v[keep])) @ e[:, keep].T

    def transform(self, df: DataFrame) -> DataFrame:
        made = {f"X{i + 1}": c for i, c in enumerate(projected(self.x, self.x_center, np.ones(len(self.x)), self.x_weights))}
        made |= {f"Y{i + 1}": c for i, c in enumerate(projected(self.y, self.y_center, np.ones(len(self.y)), self.y_weights))}
        return df.withColumns(made)
