"""Generalised linear models by iteratively reweighted least squares: every step is one Gram aggregate.

Also linear and logistic shortcuts, one-vs-rest and multinomial classification, polynomial regression, mixed
models with random intercepts and slopes, inference and model comparison.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LINKS, largest, log_gamma
from ..functions.special import chisq_cdf, normal_cdf, normal_quantile
from ..plans import formula as fm
from ..plans.gram import gram, gram_by
from ..plans.pipeline import parallel
from ..sources.models import saveable
from ..sources.tables import normalize, settled

TINY = 1e-10


def _log_ratio(y: Column, mu: Column) -> Column:
    return F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0))


#: family -> (default link, variance of mu, unit deviance of y and mu, start of mu).
FAMILIES = {
    "gaussian": ("identity", lambda m, t: F.lit(1.0), lambda y, m, t: (y - m) * (y - m), lambda y, mean: y),
    "binomial": ("logit", lambda m, t: F.greatest(m * (1 - m), F.lit(TINY)), lambda y, m, t: 2 * (_log_ratio(y, m) + _log_ratio(1 - y, 1 - m)), lambda y, mean: (y + 0.5) / 2),
    "poisson": ("log", lambda m, t: F.greatest(m, F.lit(TINY)), lambda y, m, t: 2 * (_log_ratio(y, m) - (y - m)), lambda y, mean: y + 0.1),
    "gamma": ("inverse", lambda m, t: F.greatest(m * m, F.lit(TINY)), lambda y, m, t: -2 * (F.log(y / m) - (y - m) / m), lambda y, mean: y),
    "inverse_gaussian": ("inverse_squared", lambda m, t: F.greatest(m * m * m, F.lit(TINY)), lambda y, m, t: (y - m) * (y - m) / (y * m * m), lambda y, mean: y),
    "negative_binomial": ("log", lambda m, t: F.greatest(m + m * m / t, F.lit(TINY)), lambda y, m, t: 2 * (_log_ratio(y, m) - (y + t) * F.log((y + t) / (m + t))), lambda y, mean: y + 0.1),
}


def linear(names: list[str], beta) -> Column:
    return reduce(lambda s, t: s + t, [F.col(f"`{c}`") * float(b) for c, b in zip(names, beta)], F.lit(0.0))


@saveable
@dataclass
class GLM:
    """A fitted model. terms: names of the design's columns; formula: the text they were made from."""

    formula: str
    family: str
    link: str
    terms: list
    coefficients: list
    covariance: np.ndarray
    deviance: float
    null_deviance: float
    log_likelihood: float
    aic: float
    bic: float
    dispersion: float
    n: int
    df_residual: int
    converged: bool
    iterations: int
    theta: float = 1.0
    intercept: bool = True
    warnings: list = field(default_factory=list)

    @property
    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0))

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance else 0.0

    def p_values(self) -> np.ndarray:
        """Wald tests against the normal distribution."""
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.abs(np.asarray(self.coefficients) / self.std_errors)
        return np.array([2 * (1 - normal_cdf(float(v))) for v in z])

    def confint(self, alpha: float = 0.05) -> np.ndarray:
        w = normal_quantile(1 - alpha / 2) * self.std_errors
        b = np.asarray(self.coefficients)
        return np.column_stack((b - w, b + w))

    def summary(self, df: DataFrame) -> DataFrame:
        """term, estimate, std_error, z, p_value, low, high as a small table in ``df``'s session."""
        se, ci, p = self.std_errors, self.confint(), self.p_values()
        rows = [(t, float(b), float(s), float(b / s) if s else None, float(q), float(a), float(z)) for t, b, s, q, (a, z) in zip(self.terms, self.coefficients, se, p, ci)]
        return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z double, p_value double, low double, high double")

    def predict(self, df: DataFrame, output: str = "prediction", kind: str = "response", offset: Column | None = None, interval: float | None = None) -> DataFrame:
        """``df`` with predictions; the formula is evaluated again on its raw columns. interval: level of a mean's interval."""
        tree = fm.parse(self.formula)
        made = fm.design(tree, self.intercept)
        eta = reduce(lambda s, t: s + t, [made[t] * float(b) for t, b in zip(self.terms, self.coefficients)], F.lit(0.0))
        eta = eta if offset is None else eta + offset
        inverse = LINKS[self.link][1] if kind == "response" else (lambda e: e)
        out = df.withColumn("__eta", eta)
        columns = {output: inverse(F.col("__eta"))}
        if interval is not None:
            var = F.lit(0.0)
            for i, a in enumerate(self.terms):
                for j, b in enumerate(self.terms):
                    var = var + made[a] * made[b] * float(self.covariance[i, j])
            w = F.sqrt(F.greatest(var, F.lit(0.0))) * normal_quantile(0.5 + interval / 2)
            ends = [inverse(F.col("__eta") - w), inverse(F.col("__eta") + w)]
            columns |= {f"{output}_low": F.least(*ends), f"{output}_high": F.greatest(*ends)}
        return out.withColumns(columns).drop("__eta")

    def residuals(self, df: DataFrame, output: str = "residual") -> DataFrame:
        tree = fm.parse(self.formula)
        return self.predict(df, "fitted").withColumn(output, fm.response(tree) - F.col("fitted"))


def _likelihood(family: str, y: Column, mu: Column, theta: float, w: Column) -> list[Column]:
    """Two terms of a row whose sums, with the deviance, give the log-likelihood; see _log_likelihood."""
    zero = F.lit(0.0)
    if family == "gaussian":
        return [zero, zero]
    if family == "binomial":
        return [w * (F.when(y > 0, y * F.log(mu)).otherwise(zero) + F.when(y < 1, (1 - y) * F.log(1 - mu)).otherwise(zero)), zero]
    if family == "poisson":
        return [w * (y * F.log(mu) - mu - log_gamma(y + 1)), zero]
    if family == "gamma":
        return [w * (F.log(y / mu) - y / mu), w * F.log(y)]
    if family == "inverse_gaussian":
        return [zero, w * F.log(y)]
    return [w * (y * F.log(mu) - (theta + y) * F.log(theta + mu) + log_gamma(y + theta) - log_gamma(y + 1)), zero]


def _log_likelihood(family: str, sums: dict, phi: float, theta: float) -> float:
    """From the sums of weights, deviance and _likelihood's terms; phi: the likelihood's own scale."""
    w, dev, a, b = (float(sums[k] or 0.0) for k in ("w", "dev", "a", "b"))
    scale = w * (math.log(phi) + math.log(2 * math.pi))
    if family == "gaussian":
        return -0.5 * (dev / phi + scale)
    if family == "inverse_gaussian":
        return -0.5 * (dev / phi + scale + 3 * b)
    if family == "gamma":
        k = 1 / phi
        return k * a + w * (k * math.log(k) - math.lgamma(k)) - b
    return a + (w * (theta * math.log(theta) - math.lgamma(theta)) if family == "negative_binomial" else 0.0)


def solve(g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(solution, inverse); least-norm where the Gram is singular."""
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    s = g / np.outer(scale, scale)
    inv = np.linalg.inv(s) if np.linalg.cond(s) < 1e13 else np.linalg.pinv(s, rcond=1e-11)
    inv = inv / np.outer(scale, scale)
    return inv @ b, inv


def glm(df: DataFrame, formula: str, family: str = "gaussian", link: str | None = None, weights: Column | None = None, offset: Column | None = None, intercept: bool = True, max_iter: int = 100, tol: float = 1e-8, ridge: float = 0.0, dispersion: float | None = None, theta: float = 1.0) -> GLM:
    """Fit ``formula``; rows with a missing value are left out. ridge is added to the whole diagonal.

    gaussian with identity link takes one pass; others one pass per step, reading a cached design.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; one of {', '.join(FAMILIES)}")
    default, variance, unit, start = FAMILIES[family]
    link = link or default
    if link not in LINKS:
        raise ValueError(f"unknown link {link!r}; one of {', '.join(LINKS)}")
    g_link, g_inverse, g_slope = LINKS[link]
    tree = fm.parse(formula)
    design = fm.design(tree, intercept)
    rows = normalize(df).select(
        fm.response(tree).alias("__y"), (F.lit(1.0) if weights is None else weights.cast("double")).alias("__w"), (F.lit(0.0) if offset is None else offset.cast("double")).alias("__o"),
        *[c.alias(k) for k, c in design.items()],
    ).dropna()
    names = list(design)
    x = {k: F.col(f"`{k}`") for k in names}
    y, w, o = F.col("__y"), F.col("__w"), F.col("__o")
    one_pass = family == "gaussian" and link == "identity"
    rows = rows if one_pass else rows.cache()
    try:
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy")).first()
        beta, last, inv, converged, steps = None, math.inf, None, False, 0
        for steps in range(1, 2 if one_pass else max_iter + 1):
            if beta is None:
                mu = y if one_pass else start(y, None)
                eta = y if one_pass else g_link(mu)
            else:
                eta = linear(names, beta) + o
                mu = g_inverse(eta)
            p = len(names)
            if one_pass:
                made = gram(rows.withColumn("__z", y - o), x | {"__z": F.col("__z")}, w)
            else:
                # One step a column, each from columns made before: the code for a row stays small.
                staged = rows.withColumn("__eta", eta).withColumn("__mu", mu).withColumn("__slope", g_slope(F.col("__eta"), F.col("__mu")))
                staged = staged.withColumns({"__z": F.col("__eta") - o + (y - F.col("__mu")) / F.col("__slope"), "__ww": w * F.col("__slope") * F.col("__slope") / variance(F.col("__mu"), theta)})
                made = gram(staged, x | {"__z": F.col("__z")}, F.col("__ww"), w * unit(y, F.col("__mu"), theta))
            beta, inv = solve(made.g[:p, :p] + ridge * np.eye(p), made.g[:p, p])
            deviance = made.extra
            if one_pass:
                converged = True
                break
            if steps > 1 and abs(deviance - last) / (abs(deviance) + 0.1) < tol:
                converged = True
                break
            last = deviance
        # One closing pass: the deviances, the Pearson sum and what the likelihood needs.
        p, fixed = len(names), family in ("binomial", "poisson", "negative_binomial")
        if not total["n"]:
            raise ValueError("no complete row")
        final = rows.withColumn("__mu", g_inverse(linear(names, beta) + o))
        mu, mean = F.col("__mu"), F.lit(float(total["wy"] / total["w"]))
        parts = _likelihood(family, y, mu, theta, w)
        sums = final.agg(F.sum(w).alias("w"), F.sum(w * unit(y, mu, theta)).alias("dev"), F.sum(w * (y - mu) * (y - mu) / variance(mu, theta)).alias("chi"), F.sum(w * unit(y, mean, theta)).alias("null"), F.sum(parts[0]).alias("a"), F.sum(parts[1]).alias("b")).first()
        n, null = total["n"], sums["null"]
        phi = dispersion if dispersion is not None else 1.0 if fixed else sums["chi"] / max(n - p, 1)
        # The likelihood's own scale is the maximum-likelihood one, and it counts as a parameter.
        ml = sums["dev"] / n if family in ("gaussian", "inverse_gaussian", "gamma") else phi
        log_lik = _log_likelihood(family, sums.asDict(), max(ml, 1e-300), theta)
        k = p + (0 if fixed else 1)
    finally:
        rows.unpersist()
    notes = [] if converged else [f"no convergence in {max_iter} steps"]
    return GLM(tree.text or formula, family, link, names, [float(b) for b in beta], inv * phi, float(sums["dev"]), float(null), float(log_lik), 2 * k - 2 * log_lik, math.log(n) * k - 2 * log_lik, float(phi), int(n), int(n - p), converged, steps, float(theta), intercept, notes)


def lm(df: DataFrame, formula: str, **options) -> GLM:
    return glm(df, formula, "gaussian", **options)


def logit(df: DataFrame, formula: str, **options) -> GLM:
    return glm(df, formula, "binomial", **options)


def ols_by(df: DataFrame, by: str, formula: str) -> DataFrame:
    """A least-squares fit for each value of ``by`` (classes): by, term, estimate, std_error from one aggregate."""
    tree = fm.parse(formula)
    design = fm.design(tree)
    names, rows = list(design), []
    kind = dict(df.dtypes)[by]
    for key, g in sorted(gram_by(normalize(df), by, design | {"__y": fm.response(tree)}).items()):
        p = len(names)
        beta, inv = solve(g.g[:p, :p], g.g[:p, p])
        rss = g.g[p, p] - beta @ g.g[:p, p]
        se = np.sqrt(np.maximum(np.diag(inv) * rss / max(g.n - p, 1), 0))
        rows += [(key, t, float(b), float(s)) for t, b, s in zip(names, beta, se)]
    return df.sparkSession.createDataFrame(rows, f"`{by}` {kind}, term string, estimate double, std_error double")


def polynomial(df: DataFrame, y: str, x: str, degree: int = 2) -> GLM:
    return glm(df, f"`{y}` ~ poly(`{x}`, {degree})")


# Several classes.
def one_vs_rest(df: DataFrame, y: str, terms: str, **options) -> dict[object, GLM]:
    """A logistic model for each class of ``y``; the classes' jobs run beside each other."""
    classes = sorted(r[0] for r in df.select(y).filter(F.col(y).isNotNull()).distinct().collect())
    fits = parallel([lambda c=c: glm(df.withColumn("__is", (F.col(y) == F.lit(c)).cast("double")), f"__is ~ {terms}", "binomial", **options) for c in classes])
    return dict(zip(classes, fits))


def predict_ovr(models: dict[object, GLM], df: DataFrame, output: str = "prediction") -> DataFrame:
    for i, m in enumerate(models.values()):
        df = m.predict(df, f"__p{i}")
    best = largest([F.struct(F.col(f"__p{i}").alias("p"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(models)])
    return df.withColumn(output, best["c"]).drop(*[f"__p{i}" for i in range(len(models))])


@saveable
@dataclass
class Multinomial:
    formula: str
    classes: list
    terms: list
    coefficients: np.ndarray  # (classes - 1, terms); the first class is the reference
    log_likelihood: float
    iterations: int

    def predict(self, df: DataFrame, output: str = "prediction", prefix: str | None = None) -> DataFrame:
        made = fm.design(fm.parse(self.formula))
        eta = [F.lit(0.0)] + [reduce(lambda s, t: s + t, [made[t] * float(b) for t, b in zip(self.terms, row)], F.lit(0.0)) for row in self.coefficients]
        out = df.withColumns({f"__e{k}": e for k, e in enumerate(eta)})
        top = F.greatest(*[F.col(f"__e{k}") for k in range(len(eta))])
        total = reduce(lambda a, b: a + b, [F.exp(F.col(f"__e{k}") - top) for k in range(len(eta))])
        probs = {f"__p{k}": F.exp(F.col(f"__e{k}") - top) / total for k in range(len(eta))}
        out = out.withColumns(probs)
        best = largest([F.struct(F.col(f"__p{k}").alias("p"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(self.classes)])
        out = out.withColumn(output, best["c"])
        if prefix:
            out = out.withColumns({f"{prefix}{c}": F.col(f"__p{k}") for k, c in enumerate(self.classes)})
        return out.drop(*[f"__e{k}" for k in range(len(eta))], *[f"__p{k}" for k in range(len(eta))])


def multinomial(df: DataFrame, y: str, terms: str, max_iter: int = 50, tol: float = 1e-8, ridge: float = 1e-8) -> Multinomial:
    """Newton's method on the softmax likelihood; a step is one aggregate of gradient and Hessian sums."""
    df = normalize(df)
    classes = sorted(r[0] for r in df.select(y).filter(F.col(y).isNotNull()).distinct().collect())
    tree = fm.parse(f"__y ~ {terms}")
    design = fm.design(tree)
    names = list(design)
    rows = df.select(F.col(y).alias("__c"), *[c.alias(k) for k, c in design.items()]).dropna().cache()
    p, k = len(names), len(classes) - 1
    beta, last, steps = np.zeros((k, p)), -math.inf, 0
    x = [F.col(f"`{c}`") for c in names]
    try:
        for steps in range(1, max_iter + 1):
            eta = [linear(names, b) for b in beta]
            staged = rows.withColumns({f"__e{i}": e for i, e in enumerate(eta)})
            top = F.greatest(F.lit(0.0), *[F.col(f"__e{i}") for i in range(k)]) if k > 0 else F.lit(0.0)
            z = F.exp(-top) + reduce(lambda a, b: a + b, [F.exp(F.col(f"__e{i}") - top) for i in range(k)])
            staged = staged.withColumns({f"__p{i}": F.exp(F.col(f"__e{i}") - top) / z for i in range(k)} | {"__l": -(top + F.log(z))})
            is_class = [(F.col("__c") == F.lit(c)).cast("double") for c in classes[1:]]
            pr = [F.col(f"__p{i}") for i in range(k)]
            grads = [F.sum((is_class[i] - pr[i]) * a) for i in range(k) for a in x]
            hess = [F.sum(pr[i] * ((1.0 if i == j else 0.0) - pr[j]) * a * b) for i in range(k) for j in range(i, k) for ai, a in enumerate(x) for b in x[ai:]]
            ll = F.sum(F.col("__l") + reduce(lambda a, b: a + b, [is_class[i] * F.col(f"__e{i}") for i in range(k)]))
            got = np.array([float(v) for v in staged.agg(*[e.alias(f"s{n}") for n, e in enumerate([ll, *grads, *hess])]).first()])
            value, g, flat = got[0], got[1 : 1 + k * p], iter(got[1 + k * p :])
            h = np.zeros((k * p, k * p))
            for i in range(k):
                for j in range(i, k):
                    for a in range(p):
                        for b in range(a, p):
                            v = next(flat)
                            for r, c in {(i * p + a, j * p + b), (i * p + b, j * p + a), (j * p + b, i * p + a), (j * p + a, i * p + b)}:
                                h[r, c] = v
            if abs(value - last) < tol * (abs(value) + 1):
                last = value
                break
            last = value
            beta = beta + np.linalg.solve(h + ridge * np.eye(k * p), g).reshape(k, p)
    finally:
        rows.unpersist()
    return Multinomial(f"__y ~ {terms}", classes, names, beta, float(last), steps)


# Mixed models.
@saveable
@dataclass
class MixedModel:
    """Fixed effects, variance components by random term, and the predicted effects of each group."""

    formula: str
    family: str
    link: str
    terms: list
    coefficients: list
    std_errors: list
    group: str
    random_terms: list
    variances: list
    residual: float
    effects: dict
    log_likelihood: float
    iterations: int

    def predict(self, df: DataFrame, output: str = "prediction", kind: str = "response") -> DataFrame:
        """Groups not seen in fitting have effect 0. Effects are joined, so their number may be large."""
        tree = fm.parse(self.formula)
        made = fm.design(tree)
        eta = reduce(lambda s, t: s + t, [made[t] * float(b) for t, b in zip(self.terms, self.coefficients)], F.lit(0.0))
        rows = [(str(g), *map(float, u)) for g, u in self.effects.items()]
        spark = df.sparkSession
        table = spark.createDataFrame(rows, "__g string, " + ", ".join(f"__u{i} double" for i in range(len(self.random_terms))))
        out = df.join(table, df[self.group].cast("string") == table["__g"], "left")
        for i, t in enumerate(self.random_terms):
            z = F.lit(1.0) if t == "(Intercept)" else F.col(f"`{t}`").cast("double")
            eta = eta + F.coalesce(F.col(f"__u{i}"), F.lit(0.0)) * z
        value = LINKS[self.link][1](eta) if kind == "response" else eta
        return out.withColumn(output, value).drop("__g", *[f"__u{i}" for i in range(len(self.random_terms))])


def mixed(df: DataFrame, formula: str, family: str = "gaussian", link: str | None = None, max_iter: int = 200, tol: float = 1e-6, max_groups: int = 1_000_000) -> MixedModel:
    """``y ~ x + (1 + t | g)`` with one grouping factor, by penalised quasi-likelihood and EM for the variances.

    Per step one aggregate by group of small cross-products; groups then meet on the driver as (terms + random
    terms)^2 numbers each, which ``max_groups`` bounds.
    """
    default, variance, unit, start = FAMILIES[family]
    link = link or default
    g_link, g_inverse, g_slope = LINKS[link]
    tree = fm.parse(formula)
    if len(tree.random) != 1:
        raise ValueError("one grouping factor expected; fit crossed factors one at a time")
    group, has, slopes = tree.random[0]
    design = fm.design(tree)
    names = list(design)
    z_names = (["(Intercept)"] if has else []) + list(slopes)
    p, q = len(names), len(z_names)
    z_cols = {f"__z{i}": F.lit(1.0) if t == "(Intercept)" else F.col(f"`{t}`").cast("double") for i, t in enumerate(z_names)}
    rows = normalize(df).select(F.col(f"`{group}`").cast("string").alias("__g"), fm.response(tree).alias("__y"), *[c.alias(k) for k, c in design.items()], *[c.alias(k) for k, c in z_cols.items()]).dropna()
    if rows.select("__g").distinct().limit(max_groups + 1).count() > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    spark, beta, effects, d, phi = df.sparkSession, np.zeros(p), {}, np.eye(q), 1.0
    gaussian = family == "gaussian" and link == "identity"
    rows = rows if gaussian else settled(rows)
    columns = {**{k: F.col(f"`{k}`") for k in names}, **{k: F.col(k) for k in z_cols}, "__t": F.col("__t")}
    grams, log_lik, steps, last = None, 0.0, 0, None
    for steps in range(1, max_iter + 1):
        if grams is None or not gaussian:
            if gaussian:
                staged, w = rows.withColumn("__t", F.col("__y")), None
            elif not effects:
                mu = start(F.col("__y"), None)
                staged = rows.withColumn("__eta", g_link(mu))
            else:
                table = spark.createDataFrame([(g, *map(float, u)) for g, u in effects.items()], "__g string, " + ", ".join(f"__u{i} double" for i in range(q)))
                eta = linear(names, beta)
                for i in range(q):
                    eta = eta + F.col(f"__u{i}") * F.col(f"__z{i}")
                staged = rows.join(table, "__g").withColumn("__eta", eta)
            if not gaussian:
                staged = staged.withColumn("__mu", g_inverse(F.col("__eta")))
                slope = g_slope(F.col("__eta"), F.col("__mu"))
                staged = staged.withColumn("__t", F.col("__eta") + (F.col("__y") - F.col("__mu")) / slope)
                w = slope * slope / variance(F.col("__mu"), 1.0)
            grams = gram_by(staged, "__g", columns, w)
        # Henderson's equations, groups eliminated one by one.
        d_inv = np.linalg.inv(d) * phi
        lhs, rhs, parts = np.zeros((p, p)), np.zeros(p), {}
        for k, g in grams.items():
            xx, xz, zz, xt, zt = g.g[:p, :p], g.g[:p, p : p + q], g.g[p : p + q, p : p + q], g.g[:p, -1], g.g[p : p + q, -1]
            c = np.linalg.inv(zz + d_inv)
            parts[k] = (c, xz, zt)
            lhs += xx - xz @ c @ xz.T
            rhs += xt - xz @ c @ zt
        inv = np.linalg.pinv(lhs)
        beta = inv @ rhs
        effects = {k: c @ (zt - xz.T @ beta) for k, (c, xz, zt) in parts.items()}
        m = len(effects)
        # EM: expected squares of effects and residuals.
        d_new = sum(np.outer(u, u) + phi * (parts[k][0] + parts[k][0] @ parts[k][1].T @ inv @ parts[k][1] @ parts[k][0]) for k, u in effects.items()) / m
        d_new = (d_new + d_new.T) / 2 + 1e-10 * np.eye(q)
        n = sum(g.n for g in grams.values()) if gaussian else 0
        phi_new = 1.0
        if family in ("gaussian", "gamma", "inverse_gaussian"):
            rss, trace = 0.0, p
            for k, g in grams.items():
                theta = np.concatenate((beta, effects[k]))
                a = g.g[: p + q, : p + q]
                rss += g.g[-1, -1] - 2 * theta @ g.g[: p + q, -1] + theta @ a @ theta
                trace += q - np.trace(d_inv @ parts[k][0])
            total = sum(g.n for g in grams.values()) if gaussian else rows.count()
            phi_new = rss / max(total - trace, 1)
        now = np.concatenate((beta, d_new.ravel(), [phi_new]))
        d, phi = d_new, phi_new
        if last is not None and np.abs(now - last).max() < tol * (1 + np.abs(last).max()):
            break
        last = now
    if gaussian:
        n, quad, logdet = sum(g.n for g in grams.values()), 0.0, 0.0
        for k, g in grams.items():
            zz = g.g[p : p + q, p : p + q]
            rr = g.g[-1, -1] - 2 * beta @ g.g[:p, -1] + beta @ g.g[:p, :p] @ beta
            zr = g.g[p : p + q, -1] - g.g[:p, p : p + q].T @ beta
            quad += (rr - zr @ np.linalg.inv(zz + np.linalg.inv(d) * phi) @ zr) / phi
            logdet += np.linalg.slogdet(np.eye(q) + d @ zz / phi)[1] + g.n * math.log(phi)
        log_lik = -0.5 * (n * math.log(2 * math.pi) + logdet + quad)
    return MixedModel(formula, family, link, names, beta.tolist(), np.sqrt(np.maximum(np.diag(inv) * phi, 0)).tolist(), group, z_names, np.diag(d).tolist(), float(phi), {k: u.tolist() for k, u in effects.items()}, float(log_lik), steps)


# Comparing models.
def compare(models: dict[str, GLM]) -> list[dict]:
    """Models by AIC with differences and normalised weights."""
    best = min(m.aic for m in models.values())
    weight = {k: math.exp(-(m.aic - best) / 2) for k, m in models.items()}
    return [{"model": k, "aic": m.aic, "bic": m.bic, "log_likelihood": m.log_likelihood, "deviance": m.deviance, "delta": m.aic - best, "weight": weight[k] / sum(weight.values())} for k, m in sorted(models.items(), key=lambda x: x[1].aic)]


def likelihood_ratio(small: GLM, large: GLM) -> dict:
    stat, df = max(0.0, 2 * (large.log_likelihood - small.log_likelihood)), len(large.terms) - len(small.terms)
    if df <= 0:
        raise ValueError("the second model needs more terms")
    return {"statistic": stat, "df": df, "p_value": 1 - chisq_cdf(stat, df)}


def pairwise_likelihood_ratios(models: list[GLM]) -> list[dict]:
    order = sorted(models, key=lambda m: len(m.terms))
    return [likelihood_ratio(a, b) for a, b in zip(order, order[1:]) if len(b.terms) > len(a.terms)]


def coefficient_table(models: dict[str, GLM], df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """model, term, estimate, low, high of several models, in long form."""
    rows = [(name, t, float(b), float(lo), float(hi)) for name, m in models.items() for t, b, (lo, hi) in zip(m.terms, m.coefficients, m.confint(alpha))]
    return df.sparkSession.createDataFrame(rows, "model string, term string, estimate double, low double, high double")
