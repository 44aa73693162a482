"""Additive models, Gaussian processes and small neural networks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LINKS, largest
from ..functions.special import normal_cdf, normal_quantile
from ..plans.gram import Gram, gram
from ..sources.models import saveable
from ..sources.tables import normalize
from .features import bspline_basis, cubic_regression_basis, knots, penalty, truncated_power_basis
from .glm import FAMILIES, linear

GRID = np.logspace(-4, 6, 21)


@saveable
@dataclass
class Smooth:
    """One column's basis."""

    column: str
    basis: str
    knots: list
    low: float
    high: float
    center: list = field(default_factory=list)

    def columns(self) -> list[Column]:
        x = F.col(f"`{self.column}`").cast("double")
        u = (x - self.low) / ((self.high - self.low) or 1.0)
        at = [(k - self.low) / ((self.high - self.low) or 1.0) for k in self.knots]
        made = bspline_basis(u, at, 0.0, 1.0) if self.basis == "bs" else truncated_power_basis(u, at) if self.basis == "tp" else cubic_regression_basis(u, at)[1:]
        return [c - float(m) for c, m in zip(made, self.center)] if self.center else made

    def penalty(self, order: int) -> np.ndarray:
        n = len(self.columns())
        if self.basis == "bs":
            return penalty(n, order)
        s = np.eye(n)
        s[0, 0] = 0.0  # the linear part is free
        return s


@saveable
@dataclass
class GAM:
    """y = intercept + sum of smooths. edf by smooth; covariance of all coefficients."""

    y: str
    smooths: list
    family: str
    link: str
    coefficients: np.ndarray
    covariance: np.ndarray
    edf: list
    lam: float
    scale: float
    deviance: float
    null_deviance: float
    n: float

    def _eta(self) -> Column:
        out, at = F.lit(float(self.coefficients[0])), 1
        for s in self.smooths:
            for c in s.columns():
                out = out + c * float(self.coefficients[at])
                at += 1
        return out

    def predict(self, df: DataFrame, output: str = "prediction", level: float | None = None) -> DataFrame:
        inverse = LINKS[self.link][1]
        out = df.withColumn(output, inverse(self._eta()))
        if level is None:
            return out
        cols = [F.lit(1.0), *[c for s in self.smooths for c in s.columns()]]
        out = out.withColumn("__b", F.array(*cols))
        var = F.lit(0.0)
        for i in range(len(cols)):
            for j in range(i, len(cols)):
                var = var + F.col("__b")[i] * F.col("__b")[j] * float(self.covariance[i, j] * (1 if i == j else 2))
        w = F.sqrt(F.greatest(var, F.lit(0.0))) * normal_quantile(0.5 + level / 2)
        eta = self._eta()
        return out.withColumns({f"{output}_low": inverse(eta - w), f"{output}_high": inverse(eta + w)}).drop("__b")

    def summary(self) -> dict:
        """The intercept's Wald test, edf and a Wald test by smooth, deviance explained."""
        z = self.coefficients[0] / math.sqrt(max(self.covariance[0, 0], 1e-300))
        out = {"intercept": float(self.coefficients[0]), "z": float(z), "p_value": 2 * (1 - normal_cdf(abs(z))), "deviance_explained": 1 - self.deviance / self.null_deviance if self.null_deviance else 0.0, "smooths": []}
        from ..functions.special import chisq_cdf

        at = 1
        for s, edf in zip(self.smooths, self.edf):
            k = len(s.columns())
            b, v = self.coefficients[at : at + k], self.covariance[at : at + k, at : at + k]
            stat = float(b @ np.linalg.pinv(v, rcond=1e-8) @ b)
            out["smooths"].append({"column": s.column, "edf": edf, "statistic": stat, "p_value": 1 - chisq_cdf(stat, max(edf, 0.5))})
            at += k
        return out


def _penalised(g: Gram, s: np.ndarray, lam: float, k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(coefficients, inverse, edf, residual sum) of the normal equations for one penalty."""
    a = g.g[:k, :k]
    inv = np.linalg.pinv(a + lam * s + 1e-9 * np.eye(k) * np.trace(a) / k, rcond=1e-12)
    b = inv @ g.g[:k, k]
    rss = float(g.g[k, k] - 2 * b @ g.g[:k, k] + b @ a @ b)
    return b, inv, float(np.trace(inv @ a)), max(rss, 0.0)


def _choose(g: Gram, s: np.ndarray, k: int, method: str | None, lam: float) -> float:
    if method is None:
        return lam
    scale = np.trace(g.g[1:k, 1:k]) / max(np.trace(s), 1e-12)
    best = (math.inf, lam)
    for v in GRID:
        value = v * scale * 1e-3
        b, _, edf, rss = _penalised(g, s, value, k)
        if method == "GCV":
            score = g.n * rss / max(g.n - edf, 1e-9) ** 2
        else:  # REML up to constants
            a = g.g[:k, :k] + value * s
            rank = np.linalg.matrix_rank(s)
            dev = rss + value * float(b @ s @ b)
            score = (g.n - (k - rank)) * math.log(max(dev, 1e-300)) + np.linalg.slogdet(a + 1e-12 * np.eye(k))[1] - rank * math.log(value)
        best = min(best, (score, value))
    return best[1]


def gam(df: DataFrame, y: str, columns: list[str], family: str = "gaussian", n_splines: int = 4, basis: str = "tp", method: str | None = "GCV", lam: float = 1e-3, order: int = 2, max_iter: int = 25, tol: float = 1e-8, knot_kind: str = "quantile") -> GAM:
    """Penalised regression splines. One Gram of the basis columns serves every penalty tried (one a step if not gaussian)."""
    df = normalize(df).dropna(subset=[y, *columns])
    ends = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    smooths = [Smooth(c, basis, knots(df, c, n_splines, knot_kind), ends[f"a{i}"], ends[f"b{i}"]) for i, c in enumerate(columns)]
    raw = [c for s in smooths for c in s.columns()]
    means = [v or 0.0 for v in df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(raw)]).first()]
    at = 0
    for s in smooths:
        n = len(s.columns())
        s.center = means[at : at + n]
        at += n
    x = {"1": F.lit(1.0)} | {f"b{i}": c for i, c in enumerate(c for s in smooths for c in s.columns())}
    k, s = len(x), np.zeros((len(x), len(x)))
    at = 1
    for sm in smooths:
        part = sm.penalty(order)
        s[at : at + len(part), at : at + len(part)] = part
        at += len(part)
    link, variance, unit, start = FAMILIES[family]
    rows = df.select(F.col(y).cast("double").alias("__y"), *[c.alias(n) for n, c in x.items()])
    names, yy = list(x), F.col("__y")
    if family == "gaussian":
        g = gram(rows, [*names, "__y"])
        lam = _choose(g, s, k, method, lam)
        b, inv, edf, rss = _penalised(g, s, lam, k)
        scale, dev, null = rss / max(g.n - edf, 1), rss, float(g.g[k, k] - g.s[k] ** 2 / g.n)
    else:
        g_link, g_inverse, g_slope = LINKS[link]
        rows, b, last = rows.cache(), None, math.inf
        for _ in range(max_iter):
            eta = g_link(start(yy, None)) if b is None else linear(names, b)
            staged = rows.withColumn("__e", eta).withColumn("__m", g_inverse(F.col("__e")))
            sl = g_slope(F.col("__e"), F.col("__m"))
            g = gram(staged.withColumns({"__z": F.col("__e") + (yy - F.col("__m")) / sl, "__w": sl * sl / variance(F.col("__m"), 1.0)}), [*names, "__z"], F.col("__w"))
            lam = _choose(g, s, k, method, lam)
            b, inv, edf, _ = _penalised(g, s, lam, k)
            dev = rows.agg(F.sum(unit(yy, g_inverse(linear(names, b)), 1.0))).first()[0]
            if abs(dev - last) < tol * (abs(dev) + 0.1):
                break
            last = dev
        mean = rows.agg(F.avg("__y")).first()[0]
        null, scale = rows.agg(F.sum(unit(yy, F.lit(float(mean)), 1.0))).first()[0], 1.0
        rows.unpersist()
    each, at, influence = [], 1, np.diag(inv @ g.g[:k, :k])
    for sm in smooths:
        n = len(sm.columns())
        each.append(float(influence[at : at + n].sum()))
        at += n
    return GAM(y, smooths, family, link, b, inv * scale, each, float(lam), float(scale), float(dev), float(null), g.n)


@dataclass
class GAMClassifier:
    classes: list
    models: list

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Softmax of the classes' logits against the first class."""
        eta = [F.lit(0.0), *[m._eta() for m in self.models]]
        best = largest([F.struct(e.alias("e"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (e, c) in enumerate(zip(eta, self.classes))])
        return df.withColumn(output, best["c"])


def gam_classifier(df: DataFrame, y: str, columns: list[str], **options) -> GAMClassifier:
    """K - 1 penalised logistic models, each class against the first."""
    classes = sorted(r[0] for r in df.select(y).filter(F.col(y).isNotNull()).distinct().collect())
    models = []
    for c in classes[1:]:
        part = df.filter(F.col(y).isin(classes[0], c)).withColumn("__is", (F.col(y) == F.lit(c)).cast("double"))
        models.append(gam(part, "__is", columns, "binomial", **{"method": None, "lam": 0.1} | options))
    return GAMClassifier(classes, models)


# Kernels: functions of two matrices.
@saveable
@dataclass
class Kernel:
    """kind: rbf, matern (nu 0.5, 1.5, 2.5 or inf), periodic, rational_quadratic, dot, constant, or sum of parts."""

    kind: str
    variance: float = 1.0
    length: object = 1.0  # a number, or one for each dimension
    nu: float = 1.5
    period: float = 1.0
    alpha: float = 1.0
    parts: list = field(default_factory=list)

    def __add__(self, other: Kernel) -> Kernel:
        return Kernel("sum", parts=[self, other])

    def diagonal(self, a: np.ndarray) -> np.ndarray:
        """k(x, x) of every row."""
        if self.kind == "sum":
            return sum(p.diagonal(a) for p in self.parts)
        return self.variance + (a * a).sum(1) if self.kind == "dot" else np.full(len(a), float(self.variance))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kind == "sum":
            return sum(p(a, b) for p in self.parts)
        if self.kind == "constant":
            return np.full((len(a), len(b)), self.variance)
        if self.kind == "dot":
            return self.variance + a @ b.T
        ls = np.asarray(self.length, float)
        scaled = self.kind not in ("periodic", "rational_quadratic")
        x, z = (a / ls, b / ls) if scaled else (a, b)
        r2 = np.maximum(((x[:, None, :] - z[None, :, :]) ** 2).sum(2), 0)
        r = np.sqrt(r2)
        if self.kind == "rbf" or (self.kind == "matern" and math.isinf(self.nu)):
            return self.variance * np.exp(-r2 / 2)
        if self.kind == "matern":
            if self.nu == 0.5:
                return self.variance * np.exp(-r)
            q = math.sqrt(2 * self.nu) * r
            return self.variance * (1 + q + (q * q / 3 if self.nu == 2.5 else 0)) * np.exp(-q)
        if self.kind == "periodic":
            return self.variance * np.exp(-2 * np.sin(math.pi * r / self.period) ** 2 / ls)
        if self.kind == "rational_quadratic":
            return self.variance * (1 + r2 / (2 * self.alpha * ls * ls)) ** -self.alpha
        raise ValueError(f"unknown kernel {self.kind!r}")


@saveable
@dataclass
class GaussianProcess:
    """Exact regression on any number of rows at up to ``max_rows`` distinct points; prediction streams over any number.

    Rows at one point are as good as their mean with the noise divided by their number: the posterior and the
    likelihood are the same as by all rows.
    """

    columns: list
    kernel: Kernel
    x: np.ndarray
    chol: np.ndarray
    weights: np.ndarray
    mean: float
    scale: float
    log_likelihood: float

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], y: str, kernel: Kernel | None = None, alpha: float = 1e-6, normalize_y: bool = True, optimize: bool = True, max_rows: int = 2000, steps: int = 40) -> GaussianProcess:
        rows = normalize(df).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(y).cast("double").alias("y")).dropna()
        at = [f"x{i}" for i in range(len(columns))]
        rows = rows.groupBy(*at).agg(F.avg("y").alias("m"), F.count(F.lit(1)).cast("double").alias("k"), F.var_pop("y").alias("v")).limit(max_rows + 1).toPandas().sort_values(at).to_numpy(float)
        if len(rows) > max_rows:
            raise ValueError(f"an exact process takes at most {max_rows} distinct points; fit one per group or a sample")
        x, (t, k, within) = rows[:, :-3], rows[:, -3:].T
        n = k.sum()
        mean, scale = (0.0, 1.0)
        if normalize_y:
            mean = t @ k / n
            scale = math.sqrt(k @ (within + (t - mean) ** 2) / n) or 1.0
        t = (t - mean) / scale
        # What the likelihood of all rows has beyond that of the means: their spread around them.
        spread = float(-0.5 * (k @ within) / scale**2 / alpha - 0.5 * ((n - len(x)) * math.log(2 * math.pi * alpha) + np.log(k).sum())) if n > len(x) and alpha else 0.0
        kernel, noise = kernel or Kernel("rbf"), np.diag(alpha / k)

        def of(k: Kernel):
            try:
                c = np.linalg.cholesky(k(x, x) + noise)
            except np.linalg.LinAlgError:
                return None, None, -math.inf
            w = np.linalg.solve(c.T, np.linalg.solve(c, t))
            return c, w, float(-0.5 * t @ w - np.log(np.diag(c)).sum() - len(x) / 2 * math.log(2 * math.pi)) + spread

        best = of(kernel)
        if optimize and kernel.kind not in ("sum", "constant", "dot"):
            # Pattern search over logs of variance and length.
            step = 1.0
            for _ in range(steps):
                moved = False
                for dv, dl in ((step, 0), (-step, 0), (0, step), (0, -step)):
                    k = Kernel(kernel.kind, kernel.variance * math.exp(dv), np.asarray(kernel.length) * math.exp(dl) if np.ndim(kernel.length) else kernel.length * math.exp(dl), kernel.nu, kernel.period, kernel.alpha)
                    got = of(k)
                    if got[2] > best[2] + 1e-9:
                        kernel, best, moved = k, got, True
                if not moved:
                    step /= 2
                    if step < 1e-2:
                        break
        return cls(list(columns), kernel, x, best[0], best[1], float(mean), float(scale), best[2])

    def predict(self, df: DataFrame, output: str = "prediction", std: bool = False) -> DataFrame:
        told, inverse = df.sparkSession.sparkContext.broadcast(self), []
        kind = "struct<m:double,s:double>"

        @F.pandas_udf(kind)
        def value(*series):
            import pandas as pd

            p = told.value
            if not inverse:  # a worker inverts the factor once; a batch takes one product of matrices
                inverse.append(np.linalg.inv(p.chol))
            z = np.column_stack([s.to_numpy(float) for s in series])
            k = p.kernel(z, p.x)
            v = k @ inverse[0].T
            return pd.DataFrame({"m": k @ p.weights * p.scale + p.mean, "s": np.sqrt(np.maximum(p.kernel.diagonal(z) - (v * v).sum(1), 0)) * p.scale})

        out = df.withColumn("__v", value(*[F.col(c).cast("double") for c in self.columns]))
        return out.withColumns({output: F.col("__v.m")} | ({f"{output}_std": F.col("__v.s")} if std else {})).drop("__v")

    def samples(self, points: np.ndarray, n: int = 1, seed: int = 42, prior: bool = False) -> np.ndarray:
        """Draws of functions at points on the driver, from the posterior or the prior."""
        k = self.kernel(points, points)
        mean = np.zeros(len(points))
        if not prior:
            ks = self.kernel(points, self.x)
            mean, v = ks @ self.weights, np.linalg.solve(self.chol, ks.T)
            k = k - v.T @ v
        c = np.linalg.cholesky(k + 1e-8 * np.eye(len(points)))
        draws = mean + (c @ np.random.default_rng(seed).standard_normal((len(points), n))).T
        return draws if prior else draws * self.scale + self.mean


@saveable
@dataclass
class MLP:
    """A feed-forward network; hidden layers relu, tanh or sigmoid, linear outputs."""

    columns: list
    targets: list
    layers: list
    activation: str
    loss_history: list

    @staticmethod
    def _act(z: np.ndarray, kind: str) -> np.ndarray:
        return np.maximum(z, 0) if kind == "relu" else np.tanh(z) if kind == "tanh" else 1 / (1 + np.exp(-z)) if kind == "sigmoid" else z

    @staticmethod
    def _slope(a: np.ndarray, kind: str) -> np.ndarray:
        return (a > 0).astype(float) if kind == "relu" else 1 - a * a if kind == "tanh" else a * (1 - a) if kind == "sigmoid" else np.ones_like(a)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if i == len(self.layers) - 1 else self._act(z, self.activation))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[list, float]:
        """Sums over rows of the gradient of half the squared error, and the squared error."""
        acts = self.forward(x)
        d, grads = acts[-1] - y, []
        loss = float((d * d).sum())
        for i in range(len(self.layers) - 1, -1, -1):
            grads.append((acts[i].T @ d, d.sum(0)))
            if i:
                d = d @ self.layers[i][0].T * self._slope(acts[i], self.activation)
        return grads[::-1], loss

    def predict(self, df: DataFrame, outputs: list[str] | None = None) -> DataFrame:
        told = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def value(*series):
            import pandas as pd

            return pd.Series(list(told.value.forward(np.column_stack([s.to_numpy(float) for s in series]))[-1]))

        out = df.withColumn("__v", value(*[F.col(c).cast("double") for c in self.columns]))
        return out.withColumns({o: F.col("__v")[i] for i, o in enumerate(outputs or [f"{t}_prediction" for t in self.targets])}).drop("__v")


def mlp(df: DataFrame, columns: list[str], targets: list[str], hidden: tuple[int, ...] = (16,), activation: str = "relu", epochs: int = 50, rate: float = 0.01, batch: int = 32, local_rows: int = 100_000, seed: int = 42) -> MLP:
    """Mini-batch Adam: every epoch takes all rows in a new random order, ``batch`` at a time, whatever the size of the table.

    Up to ``local_rows`` rows are held by the driver; of larger tables Spark shuffles the rows for each epoch
    and the driver reads them a block at a time. Steps follow one another, so time grows with rows times epochs.
    """
    rows = normalize(df).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(targets)]).dropna()
    rng, sizes = np.random.default_rng(seed), [len(columns), *hidden, len(targets)]
    layers = [[rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:])]
    model = MLP(list(columns), list(targets), layers, activation, [])
    moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in layers]
    step = 0

    def update(grads, n: int) -> None:
        nonlocal step
        step += 1
        for layer, g, m in zip(model.layers, grads, moments):
            for j in range(2):
                d = g[j] / n
                m[j][0], m[j][1] = 0.9 * m[j][0] + 0.1 * d, 0.999 * m[j][1] + 0.001 * d * d
                layer[j] = layer[j] - rate * (m[j][0] / (1 - 0.9**step)) / (np.sqrt(m[j][1] / (1 - 0.999**step)) + 1e-8)

    k, total, seen = len(columns), 0.0, 0

    def learn(part: np.ndarray) -> None:
        nonlocal total, seen
        grads, loss = model.gradient(part[:, :k], part[:, k:])
        total, seen = total + loss, seen + len(part)
        update(grads, len(part))

    def blocks(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"block": [b.to_numpy(float).tobytes()]})

    local = (n := rows.limit(local_rows + 1).count()) <= local_rows
    if local:
        data = rows.toPandas().to_numpy(float)
    else:
        names, width = rows.columns, len(rows.columns)
        rows = rows.withColumn("__id", F.monotonically_increasing_id()).cache()
    for epoch in range(epochs):
        total, seen = 0.0, 0
        if local:
            rng.shuffle(data)
            for at in range(0, n, batch):
                learn(data[at : at + batch])
        else:
            left = np.zeros((0, width))
            shuffled = rows.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), "__id")).select(*names).mapInPandas(blocks, "block binary")
            for r in shuffled.toLocalIterator(prefetchPartitions=True):
                left = np.concatenate((left, np.frombuffer(r["block"]).reshape(-1, width)))
                whole = len(left) // batch * batch
                for at in range(0, whole, batch):
                    learn(left[at : at + batch])
                left = left[whole:]
            if len(left):
                learn(left)
        model.loss_history.append(total / max(seen, 1))
    if not local:
        rows.unpersist()
    return model


# Optimisers over plain functions of a parameter vector.
def minimize(f, start, gradient=None, method: str = "adam", rate: float = 0.05, max_iter: int = 2000, tol: float = 1e-10, momentum: float = 0.9) -> dict:
    """gd, momentum, rmsprop or adam; f may run a Spark aggregate. Without a gradient, central differences."""
    x = np.array(start, float)
    m, v, last = np.zeros_like(x), np.zeros_like(x), math.inf

    def slope(p):
        if gradient is not None:
            return np.asarray(gradient(p), float)
        h = 1e-6 * np.maximum(1, np.abs(p))
        return np.array([(f(p + e) - f(p - e)) / (2 * h[i]) for i, e in enumerate(np.diag(h))])

    for i in range(1, max_iter + 1):
        g = slope(x)
        if method == "gd":
            x = x - rate * g
        elif method == "momentum":
            m = momentum * m - rate * g
            x = x + m
        elif method == "rmsprop":
            v = 0.9 * v + 0.1 * g * g
            x = x - rate * g / (np.sqrt(v) + 1e-8)
        elif method == "adam":
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        else:
            raise ValueError(f"unknown method {method!r}")
        value = float(f(x))
        if abs(last - value) < tol * (abs(value) + tol) and np.abs(g).max() < 1e-5:
            break
        last = value
    return {"x": x, "value": float(f(x)), "iterations": i}


def minimize_scalar(f, low: float, high: float, tol: float = 1e-10) -> float:
    """Golden-section search, then steps by slope and curvature: values alone tell a minimum to half their digits only."""
    r = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - r * (b - a), a + r * (b - a)
    while b - a > tol * (1 + abs(a) + abs(b)):
        if f(c) < f(d):
            b, d = d, c
            c = b - r * (b - a)
        else:
            a, c = c, d
            d = a + r * (b - a)
    x = (a + b) / 2
    h = 1e-3 * max(1.0, abs(x))
    if low <= x - 2 * h and x + 2 * h <= high:
        for _ in range(2):
            near = {k: f(x + k * h) for k in (-2, -1, 0, 1, 2)}
            slope, bend = (8 * (near[1] - near[-1]) - (near[2] - near[-2])) / (12 * h), (near[1] - 2 * near[0] + near[-1]) / h**2
            if not bend > 0 or not abs(slope / bend) < 1e-5 * max(1.0, abs(x)):
                break
            x -= slope / bend
    return x


def root_scalar(f, low: float, high: float, tol: float = 1e-12) -> float:
    """Bisection; the ends must have different signs."""
    fa = f(low)
    if fa * f(high) > 0:
        raise ValueError("no change of sign between the ends")
    while high - low > tol * (1 + abs(low) + abs(high)):
        mid = (low + high) / 2
        fm = f(mid)
        if fa * fm <= 0:
            high = mid
        else:
            low, fa = mid, fm
    return (low + high) / 2


def least_squares(residuals, start, max_iter: int = 200, tol: float = 1e-12) -> dict:
    """Levenberg-Marquardt with numeric derivatives."""
    x, lam = np.array(start, float), 1e-3
    r = np.asarray(residuals(x), float)
    for i in range(max_iter):
        h = 1e-7 * np.maximum(1, np.abs(x))
        j = np.column_stack([(np.asarray(residuals(x + e)) - r) / h[k] for k, e in enumerate(np.diag(h))])
        a, g = j.T @ j, j.T @ r
        step = np.linalg.solve(a + lam * (np.diag(np.diag(a)) + 1e-12 * np.eye(len(x))), -g)
        new = np.asarray(residuals(x + step), float)
        if new @ new < r @ r:
            done = r @ r - new @ new < tol * (r @ r + tol)
            x, r, lam = x + step, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return {"x": x, "cost": float(r @ r) / 2, "iterations": i + 1}


def curve_fit(f, xs, ys, start) -> np.ndarray:
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    return least_squares(lambda p: f(xs, *p) - ys, start)["x"]
