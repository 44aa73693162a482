"""Chains of transforms and a final estimator, parallel branches, cross-validation and parameter search.

An estimator here is any object with ``fit(df) -> model``; a model has ``predict(df, output)`` or
``transform(df)``. Folds and candidates are independent Spark jobs, run by a few driver threads.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import resample
from .formula import design, parse, response
from .gram import Gram, gram_by

THREADS = 4


def parallel(tasks: list[Callable[[], Any]]) -> list:
    """Results of independent driver tasks, in order."""
    with ThreadPoolExecutor(THREADS) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


@dataclass
class Pipeline:
    """steps: (name, estimator) pairs; all but the last give models with transform()."""

    steps: list[tuple[str, Any]]
    models: list[tuple[str, Any]] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Pipeline:
        models = []
        for i, (name, est) in enumerate(self.steps):
            model = est.fit(df)
            models.append((name, model))
            if i + 1 < len(self.steps):
                df = model.transform(df)
        return Pipeline(self.steps, models)

    def transform(self, df: DataFrame) -> DataFrame:
        for _, m in self.models:
            if hasattr(m, "transform"):
                df = m.transform(df)
        return df

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        for _, m in self.models[:-1]:
            df = m.transform(df)
        return self.models[-1][1].predict(df, output)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def final(self) -> Any:
        return (self.models or self.steps)[-1][1]


# Combining several predictions of a row.
def combine(columns: list[str], how: str = "vote", weights: list[float] | None = None) -> Column:
    """vote (ties: the label of the first branch that gave it), weighted_vote, average, max or min."""
    cs = [F.col(c) for c in columns]
    if how == "average":
        w = weights or [1.0] * len(cs)
        return sum((c * float(v) for c, v in zip(cs, w)), F.lit(0.0)) / float(sum(w))
    if how in ("max", "min"):
        return (F.greatest if how == "max" else F.least)(*cs)
    if how not in ("vote", "weighted_vote"):
        raise ValueError(f"unknown combiner {how!r}")
    w = weights if how == "weighted_vote" and weights else [1.0] * len(cs)
    scored = []
    for i, c in enumerate(cs):
        votes = sum((F.when(o == c, float(v)).otherwise(0.0) for o, v in zip(cs, w)), F.lit(0.0))
        scored.append(F.struct(votes.alias("v"), F.lit(-i).alias("i"), c.alias("c")))
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["c"]


def agreement(columns: list[str]) -> Column:
    """Share of pairs of branches with the same prediction."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return sum(((F.col(a) == F.col(b)).cast("double") for a, b in pairs), F.lit(0.0)) / len(pairs)


def confidence(columns: list[str], result: str) -> Column:
    """Share of branches that gave the combined prediction."""
    return sum(((F.col(c) == F.col(result)).cast("double") for c in columns), F.lit(0.0)) / len(columns)


@dataclass
class BranchPipeline:
    branches: dict[str, Any]
    how: str | Callable[[list[str]], Column] = "vote"
    weights: list[float] | None = None
    models: dict[str, Any] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> BranchPipeline:
        fitted = parallel([lambda e=e: e.fit(df) for e in self.branches.values()])
        return BranchPipeline(self.branches, self.how, self.weights, dict(zip(self.branches, fitted)))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        columns = [f"{output}_{n}" for n in self.models]
        for c, m in zip(columns, self.models.values()):
            df = m.predict(df, c)
        value = self.how(columns) if callable(self.how) else combine(columns, self.how, self.weights)
        df = df.withColumn(output, value)
        return df.withColumns({f"{output}_agreement": agreement(columns), f"{output}_confidence": confidence(columns, output)}) if len(columns) > 1 else df


# Cross-validation and search.
def cross_validate(df: DataFrame, keys: list[str], fit: Callable[[DataFrame], Any], score: Callable[[Any, DataFrame], float], k: int = 5, shuffle: bool = False, seed: int = 42, folds: DataFrame | None = None) -> dict:
    """Scores by fold, mean and population deviation. folds: ``df`` with a fold column, if there already."""
    marked = (folds if folds is not None else resample.k_fold(df, keys, k, shuffle, seed)).cache()
    try:
        numbers = sorted(r[0] for r in marked.select("fold").distinct().collect())
        one = lambda f: score(fit(marked.filter(F.col("fold") != f).drop("fold")), marked.filter(F.col("fold") == f).drop("fold"))
        scores = parallel([lambda f=f: one(f) for f in numbers])
    finally:
        marked.unpersist()
    return {"scores": scores, "mean": float(np.mean(scores)), "std": float(np.std(scores))}


def cross_validate_linear(df: DataFrame, keys: list[str], formula: str, k: int = 5, shuffle: bool = False, seed: int = 42) -> dict:
    """Least squares over all folds from one aggregate: a fold's training sums are the total less its own."""
    tree = parse(formula)
    x = design(tree)
    parts = gram_by(resample.k_fold(df, keys, k, shuffle, seed), "fold", x | {"__y": response(tree)})
    total = None
    for g in parts.values():
        total = g if total is None else total + g
    p, scores = len(x), []
    for f in sorted(parts):
        g: Gram = total - parts[f]
        b = np.linalg.lstsq(g.g[:p, :p], g.g[:p, p], rcond=None)[0]
        t = parts[f]
        scores.append(float((t.g[p, p] - 2 * b @ t.g[:p, p] + b @ t.g[:p, :p] @ b) / t.n))
    return {"mse": scores, "mean": float(np.mean(scores)), "std": float(np.std(scores))}


def grid(options: dict[str, list]) -> list[dict]:
    return [dict(zip(options, v)) for v in product(*options.values())]


@dataclass
class Search:
    best: dict
    best_score: float
    results: list[dict]
    model: Any


def search(df: DataFrame, keys: list[str], candidates: list[dict], fit: Callable[..., Any], score: Callable[[Any, DataFrame], float], k: int = 5, shuffle: bool = False, seed: int = 42) -> Search:
    """The candidate with the largest mean score, fitted again on all rows. A candidate that fails scores -infinity."""
    marked = resample.k_fold(df, keys, k, shuffle, seed).cache()

    def one(c: dict) -> dict:
        try:
            return {"params": c} | cross_validate(df, keys, lambda d: fit(d, **c), score, k, folds=marked)
        except Exception as e:  # a candidate's own failure, kept with its result
            return {"params": c, "scores": [], "mean": -math.inf, "std": 0.0, "error": str(e)}

    try:
        results = [one(c) for c in candidates]
    finally:
        marked.unpersist()
    best = max(results, key=lambda r: r["mean"])
    if best["mean"] == -math.inf:
        raise ValueError(f"every candidate failed: {best['error']}")
    return Search(best["params"], best["mean"], results, fit(df, **best["params"]))


# Distributions for random search: functions of a generator.
def uniform(a: float, b: float):
    return lambda r: float(r.uniform(a, b))


def loguniform(a: float, b: float):
    return lambda r: float(math.exp(r.uniform(math.log(a), math.log(b))))


def randint(a: int, b: int):
    return lambda r: int(r.integers(a, b))


def choice(values: list):
    return lambda r: values[int(r.integers(len(values)))]


def random_candidates(options: dict[str, Callable], n: int = 20, seed: int = 42) -> list[dict]:
    r = np.random.default_rng(seed)
    return [{k: d(r) for k, d in options.items()} for _ in range(n)]


def learning_curve(df: DataFrame, keys: list[str], fit: Callable, score: Callable, sizes: list[float] = (0.1, 0.325, 0.55, 0.775, 1.0), k: int = 5, seed: int = 42) -> list[dict]:
    """Training and test scores by share of the training rows."""
    marked = resample.k_fold(df, keys, k, True, seed).cache()
    out = []
    try:
        for s in sizes:
            def one(f, s=s):
                train = marked.filter(F.col("fold") != f).drop("fold")
                part = resample.train_test_split(train, keys, s, True, seed).filter("split = 'train'").drop("split") if s < 1 else train
                m = fit(part)
                return score(m, part), score(m, marked.filter(F.col("fold") == f).drop("fold"))

            got = parallel([lambda f=f: one(f) for f in range(1, k + 1)])
            out.append({"size": s, "train": float(np.mean([a for a, _ in got])), "test": float(np.mean([b for _, b in got]))})
    finally:
        marked.unpersist()
    return out


# Training loops with callbacks.
@dataclass
class EarlyStopping:
    """Stops when the loss has not fallen by ``delta`` for ``patience`` epochs."""

    patience: int = 10
    delta: float = 0.0
    best: float = math.inf
    waited: int = 0

    def __call__(self, epoch: int, loss: float, state: dict) -> bool:
        if loss < self.best - self.delta:
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


@dataclass
class RateSchedule:
    """state["rate"] times ``factor`` every ``every`` epochs."""

    factor: float = 0.5
    every: int = 10

    def __call__(self, epoch: int, loss: float, state: dict) -> bool:
        if epoch and epoch % self.every == 0:
            state["rate"] *= self.factor
        return False


@dataclass
class Checkpoint:
    """Keeps the best state seen."""

    best: float = math.inf
    saved: dict | None = None

    def __call__(self, epoch: int, loss: float, state: dict) -> bool:
        if loss < self.best:
            self.best, self.saved = loss, {k: v.copy() if hasattr(v, "copy") else v for k, v in state.items()}
        return False


def train(step: Callable[[dict], float], state: dict, epochs: int = 100, callbacks: list[Callable] = ()) -> list[float]:
    """Run ``step`` (which changes ``state`` and gives the loss) until the epochs or a callback end it."""
    history = []
    for epoch in range(epochs):
        history.append(float(step(state)))
        if any([c(epoch, history[-1], state) for c in callbacks]):
            break
    return history
