"""Hypothesis tests: statistics by one aggregate (ranks by a distributed order), p-values on the driver."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation
from ..functions.special import chisq_cdf, f_cdf, normal_cdf, normal_quantile, t_cdf
from ..plans.ordering import average_ranks, indexed, running


def tail(cdf: float, alternative: str) -> float:
    """p-value of a statistic with distribution value ``cdf``."""
    if alternative == "less":
        return cdf
    if alternative == "greater":
        return 1 - cdf
    if alternative != "two-sided":
        raise ValueError("alternative is two-sided, less or greater")
    return min(1.0, 2 * min(cdf, 1 - cdf))


def moments(df: DataFrame, value: str, group: str | None = None) -> dict:
    """group -> (n, mean, sample variance)."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*([group] if group else [])).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v")).collect()
    return {r[group] if group else None: (r["n"], r["m"], r["v"] or 0.0) for r in rows}


def _t(diff: float, se: float, df: float, alternative: str) -> dict:
    if se == 0:
        t = 0.0 if diff == 0 else math.copysign(math.inf, diff)
        cdf = 0.5 if diff == 0 else float(diff > 0)
    else:
        t = diff / se
        cdf = t_cdf(t, df)
    return {"statistic": t, "df": df, "p_value": tail(cdf, alternative)}


def t_one(df: DataFrame, value: str, mu: float = 0.0, alternative: str = "two-sided") -> dict:
    n, m, v = moments(df, value)[None]
    return _t(m - mu, math.sqrt(v / n), n - 1, alternative) | {"n": n, "mean": m, "se": math.sqrt(v / n)}


def two_groups(df: DataFrame, value: str, group: str) -> list[tuple]:
    got = moments(df.filter(F.col(group).isNotNull()), value, group)
    if len(got) != 2:
        raise ValueError(f"two groups expected, {len(got)} found")
    return [(k, *got[k]) for k in sorted(got)]


def t_two(df: DataFrame, value: str, group: str, alternative: str = "two-sided") -> dict:
    """Pooled variance."""
    (_, n1, m1, v1), (_, n2, m2, v2) = two_groups(df, value, group)
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return _t(m1 - m2, math.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2, alternative) | {"mean1": m1, "mean2": m2, "pooled_variance": pooled}


def t_paired(df: DataFrame, a: str, b: str, alternative: str = "two-sided") -> dict:
    return t_one(df.select((F.col(a).cast("double") - F.col(b)).alias("d")), "d", 0.0, alternative)


def chi_square(df: DataFrame, observed: str, expected: str) -> dict:
    """Goodness of fit over rows of counts."""
    r = df.agg(F.sum((F.col(observed) - F.col(expected)) * (F.col(observed) - F.col(expected)) / F.col(expected)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return {"statistic": r["s"], "df": r["n"] - 1, "p_value": 1 - chisq_cdf(r["s"], r["n"] - 1)}


def anova_of(groups: dict) -> dict:
    n, k = sum(g[0] for g in groups.values()), len(groups)
    mean = sum(g[0] * g[1] for g in groups.values()) / n
    ssb = sum(g[0] * (g[1] - mean) ** 2 for g in groups.values())
    ssw = sum((g[0] - 1) * g[2] for g in groups.values())
    msb, msw = ssb / (k - 1), ssw / (n - k)
    f = msb / msw if msw else math.inf
    return {"statistic": f, "df_between": k - 1, "df_within": n - k, "ss_between": ssb, "ss_within": ssw, "ms_between": msb, "ms_within": msw, "p_value": 1 - f_cdf(f, k - 1, n - k) if msw else 0.0}


def anova(df: DataFrame, value: str, group: str) -> dict:
    return anova_of(moments(df, value, group))


def eta_squared(a: dict) -> float:
    return a["ss_between"] / (a["ss_between"] + a["ss_within"])


def omega_squared(a: dict) -> float:
    return (a["ss_between"] - a["df_between"] * a["ms_within"]) / (a["ss_between"] + a["ss_within"] + a["ms_within"])


def cohens_d(df: DataFrame, value: str, group: str, pooled: bool = True) -> float:
    (_, n1, m1, v1), (_, n2, m2, v2) = two_groups(df, value, group)
    return (m1 - m2) / math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) if pooled else v1)


def studentized_range_cdf(q: float, k: int, df: float, steps: int = 64) -> float:
    """Distribution of the studentized range, by quadrature over the normal range and the chi scale."""
    if q <= 0:
        return 0.0

    def normal_range(w: float) -> float:
        h = 16 / 128
        return min(1.0, k * sum((normal_cdf(z) - normal_cdf(z - w)) ** (k - 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) for z in (-8 + (i + 0.5) * h for i in range(128))) * h)

    log_c = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - spread), 1 + spread
    h = (high - low) / steps
    total = norm = 0.0
    for i in range(steps):
        s = low + (i + 0.5) * h
        w = math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * h
        total, norm = total + w * normal_range(q * s), norm + w
    return total / norm


def tukey_hsd(df: DataFrame, value: str, group: str) -> DataFrame:
    """All pairs of groups: diff, se, q and p (the studentized range by quadrature). Groups are few: classes."""
    g = moments(df, value, group)
    a = anova_of(g)
    rows = []
    for x, y in combinations(sorted(g), 2):
        se = math.sqrt(a["ms_within"] / 2 * (1 / g[x][0] + 1 / g[y][0]))
        q = abs(g[x][1] - g[y][1]) / se if se else math.inf
        rows.append((str(x), str(y), float(g[x][1] - g[y][1]), se, q, max(0.0, 1 - studentized_range_cdf(q, len(g), a["df_within"]))))
    return df.sparkSession.createDataFrame(rows, "a string, b string, diff double, se double, q double, p_value double")


def rank_sums(df: DataFrame, value: str, group: str) -> dict:
    """group -> (n, sum of average ranks)."""
    ranked = average_ranks(df.select(value, group).filter(F.col(group).isNotNull()), value)
    return {r[group]: (r["n"], r["s"]) for r in ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("s")).collect()}


def mann_whitney(df: DataFrame, value: str, group: str) -> dict:
    """The smaller U; normal approximation without corrections."""
    got = rank_sums(df, value, group)
    if len(got) != 2:
        raise ValueError(f"two groups expected, {len(got)} found")
    (n1, r1), (n2, _) = (got[k] for k in sorted(got))
    u1 = r1 - n1 * (n1 + 1) / 2
    u = min(u1, n1 * n2 - u1)
    z = (u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return {"statistic": u, "u1": u1, "u2": n1 * n2 - u1, "z": z, "p_value": min(1.0, 2 * normal_cdf(z))}


def kruskal_wallis(df: DataFrame, value: str, group: str) -> dict:
    got = rank_sums(df, value, group)
    n = sum(k for k, _ in got.values())
    h = 12 / (n * (n + 1)) * sum(s * s / k for k, s in got.values()) - 3 * (n + 1)
    return {"statistic": h, "df": len(got) - 1, "p_value": 1 - chisq_cdf(h, len(got) - 1)}


def levene(df: DataFrame, value: str, group: str, center: str = "median", trim: float = 0.1) -> dict:
    """ANOVA of absolute deviations from the group's mean, median or trimmed mean."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(F.col(group).alias("g"), v.alias("v"))
    if center == "trimmed":
        placed = indexed(rows, ["g", "v"], "at")
        span = placed.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        inside = placed.join(F.broadcast(span), "g").filter("at - first >= floor(n * %r) AND at - first < n - floor(n * %r)" % (trim, trim))
        mid = inside.groupBy("g").agg(F.avg("v").alias("c"))
    else:
        mid = rows.groupBy("g").agg((F.avg("v") if center == "mean" else F.median("v")).alias("c"))
    return anova(rows.join(mid, "g").select("g", F.abs(F.col("v") - F.col("c")).alias("d")), "d", "g")


def _correlation(r: float, n: int) -> dict:
    if n < 3:
        return {"statistic": 0.0, "r": r, "n": n, "df": n - 2, "p_value": 1.0, "ci_low": -1.0, "ci_high": 1.0}
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.copysign(math.inf, r)
    p = tail(t_cdf(t, n - 2), "two-sided") if math.isfinite(t) else 0.0
    low = high = r
    if abs(r) < 1 and n > 3:
        z, w = math.atanh(r), normal_quantile(0.975) / math.sqrt(n - 3)
        low, high = math.tanh(z - w), math.tanh(z + w)
    return {"statistic": t, "r": r, "n": n, "df": n - 2, "p_value": p, "ci_low": low, "ci_high": high}


def pearson(df: DataFrame, a: str, b: str) -> dict:
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    r = rows.agg(correlation(F.col("a"), F.col("b")).alias("r"), F.count(F.lit(1)).alias("n")).first()
    value = r["r"]
    return _correlation(0.0, r["n"]) | {"p_value": 1.0} if value is None or math.isnan(value) else _correlation(value, r["n"])


def spearman(df: DataFrame, a: str, b: str) -> dict:
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    ranked = average_ranks(average_ranks(rows, "a", "ra"), "b", "rb")
    return pearson(ranked, "ra", "rb")


def fisher_exact(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> dict:
    """A 2 x 2 table; two-sided: all tables as likely as this one or less."""
    r1, r2, c1 = a + b, c + d, a + c
    low, high = max(0, c1 - r2), min(r1, c1)
    # Beyond 40 deviations from the mode no table adds to a sum; of large counts only those within are made.
    n = max(1, r1 + r2)
    mode, wide = (r1 + 1) * (c1 + 1) // (n + 2), int(40 * math.sqrt(r1 * r2 / n * c1 / n * (n - c1) / n)) + 1000
    low, high = max(low, min(a, mode - wide)), min(high, max(a, mode + wide))
    x = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log((r1 - x) * (c1 - x)) - np.log((x + 1) * (r2 - c1 + x + 1)))))
    logs -= logs.max()
    at = a - low
    pick = {"less": slice(0, at + 1), "greater": slice(at, None), "two-sided": logs <= logs[at] + 1e-7}[alternative]
    odds = a * d / (b * c) if b * c else math.inf if a * d else math.nan
    return {"odds_ratio": odds, "p_value": min(1.0, float(math.fsum(np.exp(logs[pick])) / math.fsum(np.exp(logs))))}


# Several tests at once: columns of p-values.
def bonferroni(df: DataFrame, p: str, output: str = "adjusted") -> DataFrame:
    n = df.agg(F.count(p).alias("__m"))
    return df.crossJoin(F.broadcast(n)).withColumn(output, F.least(F.lit(1.0), F.col(p) * F.col("__m"))).drop("__m")


def _places(df: DataFrame, p: str, key: str) -> DataFrame:
    placed = indexed(df, [p, key], "__at")
    return placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("__m"))))


def _running_extreme(df: DataFrame, value: Column, largest: bool, output: str) -> DataFrame:
    """Running max (from the front) or min (from the back) by place: by block of places, then over blocks."""
    from pyspark.sql.window import Window

    size = 10_000
    f = F.max if largest else F.min
    rows = df.withColumn("__v", value).withColumn("__block", F.floor(F.col("__at") / size))
    order = F.col("__at") if largest else F.col("__at").desc()
    blocks = rows.groupBy("__block").agg(f("__v").alias("__e"))
    w = Window.orderBy(F.col("__block") if largest else F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("__block", f("__e").over(w).alias("__base"))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(bases, "__block")
    pick = F.greatest if largest else F.least
    return out.withColumn(output, pick(f("__v").over(inside), F.col("__base"))).drop("__v", "__block", "__base")


def holm(df: DataFrame, p: str, key: str, output: str = "adjusted") -> DataFrame:
    """Step-down: running maximum of p (m - place)."""
    rows = _places(df, p, key)
    return _running_extreme(rows, F.least(F.lit(1.0), F.col(p) * (F.col("__m") - F.col("__at"))), True, output).drop("__at", "__m")


def benjamini_hochberg(df: DataFrame, p: str, key: str, output: str = "adjusted", alpha: float = 0.05) -> DataFrame:
    """Step-up: running minimum from the largest of p m / place; and the critical value of each place."""
    rows = _places(df, p, key)
    out = _running_extreme(rows, F.least(F.lit(1.0), F.col(p) * F.col("__m") / (F.col("__at") + 1)), False, output)
    return out.withColumn("critical", (F.col("__at") + 1) / F.col("__m") * alpha).drop("__at", "__m")


def cumulative_share(df: DataFrame, value: str, key: str, output: str = "share") -> DataFrame:
    """Running share of a total by rising value."""
    rows = running(df, [value, key], {"__sum": F.col(value).cast("double")})
    return rows.crossJoin(F.broadcast(rows.agg(F.max("__sum").alias("__all")))).withColumn(output, F.try_divide(F.col("__sum"), F.col("__all"))).drop("__sum", "__all")
