"""Interpretation: importances, partial dependence, Shapley values, residuals; and the data behind plots."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normal_inverse
from ..plans.ordering import indexed, picked
from ..sources.tables import settled
from .resample import shuffled

Scorer = Callable[[DataFrame], DataFrame]


def permutation_importance(df: DataFrame, columns: list[str], key: str, score: Callable[[DataFrame], float], repeats: int = 10, seed: int = 42) -> list[dict]:
    """Baseline score less the score with a column's values dealt to other rows: mean and population deviation, largest first.

    A repeat is one order of the rows by a hash; every column in turn takes its values from there.
    """
    base, drops = score(df), {c: [] for c in columns}
    placed = settled(indexed(df, [key], "__at"))
    for r in range(repeats):
        other = indexed(df.select(key, *[F.col(c).alias(f"__v_{c}") for c in columns]), shuffled([key], seed + r), "__at").drop(key)
        both = settled(placed.join(other, "__at"))
        for c in columns:
            drops[c].append(base - score(both.withColumn(c, F.col(f"__v_{c}")).select(*df.columns)))
    out = [{"feature": c, "importance": float(np.mean(d)), "std": float(np.std(d))} for c, d in drops.items()]
    return sorted(out, key=lambda d: -d["importance"])


def coefficient_importance(terms: list[str], coefficients: list[float]) -> list[dict]:
    return sorted(({"feature": t, "importance": abs(float(b)), "coefficient": float(b)} for t, b in zip(terms, coefficients) if t != "(Intercept)"), key=lambda d: -d["importance"])


def partial_dependence(df: DataFrame, column: str, predict: Column, points: int = 20) -> DataFrame:
    """value, mean_prediction on a grid between the values at the places floor(.05 n) and floor(.95 n).

    predict: the model as a Column. The grid is an array of ``points`` numbers, exploded beside each row.
    """
    n = df.filter(F.col(column).isNotNull()).count()
    low, high = (float(v) for v in picked(df, column, [int(n * 0.05), int(n * 0.95)]))
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    at = df.drop(column).withColumn(column, F.explode(F.array(*[F.lit(v) for v in grid])))
    return at.withColumn("__p", predict).groupBy(F.col(column).alias("value")).agg(F.avg("__p").alias("mean_prediction"))


def residual_data(df: DataFrame, y: str, fitted: str) -> DataFrame:
    """``df`` with residual and standardized (by the population deviation)."""
    r = F.col(y).cast("double") - F.col(fitted)
    s = df.agg(F.avg(r).alias("__m"), F.stddev_pop(r).alias("__s"))
    out = df.crossJoin(F.broadcast(s))  # one row
    return out.withColumns({"residual": r, "standardized": F.coalesce(F.try_divide(r - F.col("__m"), F.col("__s")), F.lit(0.0))}).drop("__m", "__s")


# Shapley values.
def linear_shap(df: DataFrame, columns: list[str], coefficients: list[float]) -> DataFrame:
    """Exact values of a linear model: coefficient times distance from the column's mean."""
    mean = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({f"shap_{c}": (F.col(c) - float(mean[c])) * float(b) for c, b in zip(columns, coefficients)})


def _explained(df: DataFrame, columns: list[str], explain) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "base double", *(f"`shap_{c}` double" for c in columns)])

    def run(batches):
        import pandas as pd

        for b in batches:
            base, phi = explain(b[columns].to_numpy(float))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame({"base": base} | {f"shap_{c}": phi[:, i] for i, c in enumerate(columns)})], axis=1)

    return df.mapInPandas(run, schema)


def kernel_shap(df: DataFrame, columns: list[str], predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, exact_up_to: int = 12, samples: int = 2048, seed: int = 42) -> DataFrame:
    """``df`` with base and shap_ columns: all coalitions for few columns, else sampled ones and weighted least squares."""
    m = len(columns)
    rng = np.random.default_rng(seed)

    def masks() -> tuple[np.ndarray, np.ndarray]:
        if m <= exact_up_to:
            z = np.array([[i >> j & 1 for j in range(m)] for i in range(1, 2**m - 1)], float).reshape(-1, m)
            s = z.sum(1).astype(int)
            return z, np.array([(m - 1) / (math.comb(m, k) * k * (m - k)) for k in s])
        p = np.array([(m - 1) / (k * (m - k)) for k in range(1, m)])
        z = np.zeros((samples, m))
        for r in z:
            r[rng.choice(m, rng.choice(np.arange(1, m), p=p / p.sum()), replace=False)] = 1
        return z, np.ones(samples)

    z, w = masks()

    def explain(x: np.ndarray):
        base = float(np.mean(predict(background)))
        full, phi = predict(x), np.zeros((len(x), m))
        if m == 1:
            return np.full(len(x), base), (full - base)[:, None]
        a = z[:, :-1] - z[:, -1:]
        lhs = np.linalg.pinv(a.T @ (a * w[:, None]))
        for i, row in enumerate(x):
            v = np.array([np.mean(predict(np.where(mask > 0, row, background))) for mask in z]) - base
            total = full[i] - base
            phi[i, :-1] = lhs @ (a.T @ (w * (v - z[:, -1] * total)))
            phi[i, -1] = total - phi[i, :-1].sum()
        return np.full(len(x), base), phi

    return _explained(df, columns, explain)


def permutation_shap(df: DataFrame, columns: list[str], predict, background: np.ndarray, permutations: int = 64, seed: int = 42) -> DataFrame:
    """Mean contributions along orders of the columns and their reverses."""
    m, rng = len(columns), np.random.default_rng(seed)
    orders = [o for _ in range(permutations // 2) for p in [rng.permutation(m)] for o in (p, p[::-1])]

    def explain(x: np.ndarray):
        base, phi = float(np.mean(predict(background))), np.zeros((len(x), m))
        for i, row in enumerate(x):
            for o in orders:
                now, last = background.copy(), base
                for j in o:
                    now[:, j] = row[j]
                    value = float(np.mean(predict(now)))
                    phi[i, j] += value - last
                    last = value
        return np.full(len(x), base), phi / len(orders)

    return _explained(df, columns, explain)


def tree_shap(df: DataFrame, tree, output_class: int | None = None) -> DataFrame:
    """Path-dependent Shapley values of a tree or forest, exact: coalitions of the features on each leaf's path."""
    trees = getattr(tree, "trees", [tree])
    columns = list(trees[0].columns)

    def leaf_value(t):
        return t["shares"][output_class] if output_class is not None else float(t["value"])

    def leaves(t) -> list:
        """(value, {feature: (low, high, share of rows that follow)}) of every leaf."""
        out, stack = [], [(0, {})]
        while stack:
            i, way = stack.pop()
            node = t.nodes[i]
            if "feature" not in node:
                out.append((leaf_value(node), way))
                continue
            f, cut = node["feature"], node["threshold"]
            low, high, share = way.get(f, (-math.inf, math.inf, 1.0))
            for child, span in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
                stack.append((child, way | {f: (*span, share * t.nodes[child]["n"] / node["n"])}))
        return out

    rules = [leaves(t) for t in trees]

    def explain(x: np.ndarray):
        base, phi = np.zeros(len(x)), np.zeros((len(x), len(columns)))
        for leaf_rules in rules:
            for value, way in leaf_rules:
                fs = [columns.index(f) for f in way]
                spans = list(way.values())
                hit = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, (lo, hi, _) in zip(fs, spans)]
                share = [s for *_, s in spans]
                base += value * math.prod(share)
                d = len(fs)
                for k in range(d):
                    others = [j for j in range(d) if j != k]
                    # Elementary sums over subsets of the others, by size.
                    poly = [np.ones(len(x))]
                    for j in others:
                        grown = [p * share[j] for p in poly] + [np.zeros(len(x))]
                        for s, p in enumerate(poly):
                            grown[s + 1] = grown[s + 1] + p * hit[j]
                        poly = grown
                    weight = sum(math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) * p for s, p in enumerate(poly))
                    phi[:, fs[k]] += value * weight * (hit[k] - share[k])
        return base / len(rules), phi / len(rules)

    return _explained(df, columns, explain)


def shap_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean absolute value."""
    r = df.agg(*[F.avg(F.abs(f"shap_{c}")).alias(c) for c in columns])
    return r.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in columns])))


def shap_long(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, feature, value, shap in long form."""
    return df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col(f"shap_{c}").alias("shap")) for c in columns])))


# Data behind plots: a DataFrame and a plain description each; drawing is left to the host.
def spec(kind: str, x: str, y: str, **more) -> dict:
    return {"mark": kind, "x": x, "y": y} | more


def qq_points(df: DataFrame, value: str, key: str) -> DataFrame:
    """theoretical, sample: normal quantiles at (i + .5) / n against the sorted values."""
    placed = indexed(df.filter(F.col(value).isNotNull()).select(value, key), [value, key], "__at")
    n = placed.agg(F.count(F.lit(1)).alias("__n"))
    p = (F.col("__at") + 0.5) / F.col("__n")
    return placed.crossJoin(F.broadcast(n)).select(F.col("__at").alias("i"), p.alias("p"), normal_inverse(p).alias("theoretical"), F.col(value).cast("double").alias("sample"))


def scree(pca, spark) -> DataFrame:
    rows = [(i + 1, float(v), float(e), float(c)) for i, (v, e, c) in enumerate(zip(pca.eigenvalues, pca.explained, pca.cumulative))]
    return spark.createDataFrame(rows, "component int, eigenvalue double, percent double, cumulative double")


def scale_location(df: DataFrame, y: str, fitted: str) -> DataFrame:
    """``df`` with the root of the absolute standardized residual."""
    return residual_data(df, y, fitted).withColumn("root_abs", F.sqrt(F.abs("standardized")))


def effect_grid(df: DataFrame, column: str, others: list[str], points: int = 50) -> DataFrame:
    """A grid over one column's range with the others at their means."""
    r = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"), *[F.avg(c).alias(c) for c in others])
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    return r.select("a", "b", *others, grid).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1)).alias(column), *others)


def partial_residuals(df: DataFrame, column: str, coefficient: float, residual: str) -> DataFrame:
    return df.withColumn("partial_residual", F.col(residual) + F.col(column) * float(coefficient))


def top_importances(items: list[dict], n: int = 10) -> list[dict]:
    return sorted(items, key=lambda d: -d["importance"])[:n]


def biplot(pca, df: DataFrame, scaling: int = 2) -> dict[str, DataFrame]:
    """Sites (scores of rows) and variables (loadings)."""
    load = pca.loadings(scaling)
    rows = [(c, *map(float, load[i, :2])) for i, c in enumerate(pca.columns)]
    return {"sites": pca.transform(df, scaling), "variables": df.sparkSession.createDataFrame(rows, "variable string, x double, y double")}


def centroids(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(x).alias(x), F.avg(y).alias(y), F.count(F.lit(1)).alias("n"))


def hulls(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Convex hull of each group: group, i, x, y. Batches shrink to their own hulls first, so a group of any size fits."""
    kinds = dict(df.dtypes)

    def hull(points: np.ndarray) -> np.ndarray:
        p = np.unique(points, axis=0)
        if len(p) < 3:
            return p

        def half(rows):
            out: list = []
            for r in rows:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(r)
            return out[:-1]

        return np.array(half(list(p)) + half(list(p[::-1])))

    def shrink(batches):
        import pandas as pd

        for b in batches:
            for g, part in b.groupby("g", dropna=False):
                h = hull(part[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({"g": [g] * len(h), "x": h[:, 0], "y": h[:, 1]})

    def last(key, part):
        import pandas as pd

        h = hull(part[["x", "y"]].to_numpy(float))
        return pd.DataFrame({group: [key[0]] * len(h), "i": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    rows = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    small = rows.mapInPandas(shrink, f"g {kinds[group]}, x double, y double")
    return small.groupBy("g").applyInPandas(last, f"`{group}` {kinds[group]}, i int, x double, y double")


def all_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))
