"""Sufficient statistics: counts, sums and cross-products by one partial and final aggregate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond so many columns, sums are made by Arrow batches: generated code for all pairs grows too large.
MAX_NATIVE = 24


@dataclass
class Gram:
    """Sums over rows: n (weights), s[i] = sum w x_i, g[i, j] = sum w x_i x_j; extra: a plain sum asked for beside."""

    names: list[str]
    n: float
    s: np.ndarray
    g: np.ndarray
    extra: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return (self.g - np.outer(self.s, self.s) / self.n) / (self.n - ddof)

    def part(self, names: list[str]) -> Gram:
        at = [self.names.index(c) for c in names]
        return Gram(list(names), self.n, self.s[at], self.g[np.ix_(at, at)])

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.n - other.n, self.s - other.s, self.g - other.g)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.names, self.n + other.n, self.s + other.s, self.g + other.g)


def _unpack(names: list[str], row) -> Gram:
    p = len(names)
    flat = np.array([0.0 if v is None else float(v) for v in row["__all"]])
    g = np.zeros((p, p))
    at = np.triu_indices(p)
    g[at] = flat[1 + p :]
    return Gram(list(names), flat[0], flat[1 : 1 + p], g + np.triu(g, 1).T, float(row["__extra"] or 0.0) if "__extra" in row else 0.0)


def _native(df: DataFrame, cols: list[Column], weight: Column | None, by: list[str], extra: bool = False) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    named = df.select(*by, w.cast("double").alias("__w"), *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(cols)], *(["__e"] if extra else []))
    x = [F.col(f"__x{i}") for i in range(len(cols))]
    ww = F.col("__w")
    terms = [F.sum(ww)] + [F.sum(ww * a) for a in x] + [F.sum(ww * a * b) for i, a in enumerate(x) for b in x[i:]]
    named_terms = [t.alias(f"__s{i}") for i, t in enumerate(terms)]
    agg = named.groupBy(*by).agg(*named_terms, *([F.sum("__e").alias("__extra")] if extra else []))
    return agg.select(*by, F.array(*[F.col(f"__s{i}") for i in range(len(terms))]).alias("__all"), *(["__extra"] if extra else []))


def _batched(df: DataFrame, cols: list[Column], weight: Column | None) -> DataFrame:
    """Partial sums by Arrow batch, then one sum of small arrays by position."""
    import pandas as pd

    p = len(cols)
    w = F.lit(1.0) if weight is None else weight
    named = df.select(w.cast("double").alias("__w"), *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(cols)])
    upper = np.triu_indices(p)

    def sums(batches):
        total = None
        for b in batches:
            v = b.to_numpy(dtype=float)
            w, x = v[:, 0], v[:, 1:]
            part = np.concatenate(([w.sum()], w @ x, (x.T @ (x * w[:, None]))[upper]))
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    parts = named.mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("__all"))


def gram(df: DataFrame, columns: dict[str, Column] | list[str], weight: Column | None = None, extra: Column | None = None) -> Gram:
    """The Gram of named columns, and the sum of ``extra``; rows with a missing column are left out."""
    columns = {c: F.col(c) for c in columns} if isinstance(columns, list) else columns
    named = df.select(*[c.cast("double").alias(k) for k, c in columns.items()], *([weight.cast("double").alias("__weight")] if weight is not None else []), *([extra.cast("double").alias("__e")] if extra is not None else [])).dropna()
    cols, w = [F.col(f"`{k}`") for k in columns], None if weight is None else F.col("__weight")
    if len(cols) <= MAX_NATIVE:
        made = _native(named, cols, w, [], extra is not None)
    else:
        made = _batched(named, cols, w)
        made = made if extra is None else made.crossJoin(F.broadcast(named.agg(F.sum("__e").alias("__extra"))))  # one row each
    row = made.first()
    if row is None or not row["__all"]:
        p = len(cols)
        return Gram(list(columns), 0.0, np.zeros(p), np.zeros((p, p)))
    return _unpack(list(columns), row)


def gram_by(df: DataFrame, by: str, columns: dict[str, Column] | list[str], weight: Column | None = None) -> dict:
    """A Gram for each value of ``by``: for keys of few values (classes, folds), as the driver holds them all."""
    columns = {c: F.col(c) for c in columns} if isinstance(columns, list) else columns
    keep = df.select(F.col(by).alias("__by"), *[c.cast("double").alias(k) for k, c in columns.items()], *([weight.cast("double").alias("__weight")] if weight is not None else [])).dropna()
    rows = _native(keep, [F.col(f"`{k}`") for k in columns], None if weight is None else F.col("__weight"), ["__by"]).collect()
    return {r["__by"]: _unpack(list(columns), r) for r in rows}
