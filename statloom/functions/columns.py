"""Column builders: distances, link functions, the normal distribution, compositions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column | str) -> Column:
    return F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _summed(a, b, f: Callable[[Column, Column], Column]) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), f))


def euclidean(a, b) -> Column:
    return F.sqrt(_summed(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a, b) -> Column:
    return _summed(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a, b) -> Column:
    return F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def minkowski(a, b, p: float = 2) -> Column:
    if math.isinf(p):
        return chebyshev(a, b)
    return F.pow(_summed(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1 / p))


def cosine(a, b) -> Column:
    """1 - cos; 1 if either vector is zero."""
    dot = _summed(a, b, lambda x, y: x * y)
    norm = F.sqrt(_summed(a, a, lambda x, y: x * y)) * F.sqrt(_summed(b, b, lambda x, y: x * y))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - F.try_divide(dot, norm))


def hamming(a, b) -> Column:
    """How many entries differ."""
    return _summed(a, b, lambda x, y: (x != y).cast("double"))


def canberra(a, b) -> Column:
    return _summed(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0)))


DISTANCES: dict[str, Callable[..., Column]] = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "minkowski": minkowski, "cosine": cosine, "hamming": hamming, "canberra": canberra}


def distance(metric: str | Callable) -> Callable[..., Column]:
    """A distance by name, or a builder of one's own."""
    if callable(metric):
        return metric
    if metric not in DISTANCES:
        raise ValueError(f"unknown distance {metric!r}")
    return DISTANCES[metric]


def gower(pairs: list[tuple[Column, Column]], kinds: list[float | None]) -> Column:
    """Gower distance over (left, right) columns; kinds: the range of a numeric one, None for a categorical one.

    Pairs with a missing side are skipped; NULL if all are. A range of 0 counts as no difference.
    """
    num, den = F.lit(0.0), F.lit(0.0)
    for (a, b), width in zip(pairs, kinds):
        both = a.isNotNull() & b.isNotNull()
        d = (a != b).cast("double") if width is None else (F.abs(a - b) / F.lit(float(width)) if width else F.lit(0.0))
        num, den = num + F.when(both, d).otherwise(0.0), den + both.cast("double")
    return F.try_divide(num, den)


# Links: (link, inverse, derivative of the inverse given eta and mu), clamped where they would overflow.
_TINY, _BIG = 1e-10, 700.0


def _probability(mu: Column) -> Column:
    return F.greatest(F.lit(_TINY), F.least(F.lit(1 - _TINY), mu))


def _positive(mu: Column) -> Column:
    return F.greatest(F.lit(_TINY), mu)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


#: Abramowitz and Stegun 26.2.17: p, then b1 to b5.
AS_P, AS_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cumulative(x: Column) -> Column:
    """Normal distribution function by a polynomial; its error is below 7.5e-8."""
    t = 1 / (1 + AS_P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(AS_B):
        poly = (poly + b) * t
    upper = normal_density(x) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


#: Acklam's rational approximation of the normal quantile: numerator and denominator of the middle, then of the tails.
ACKLAM_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
ACKLAM_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
ACKLAM_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
ACKLAM_TAIL = 0.02425


def _horner(x: Column, weights) -> Column:
    out = F.lit(0.0)
    for w in weights:
        out = out * x + w
    return out


def normal_inverse(p: Column) -> Column:
    """Quantile of the normal distribution; relative error below 1.2e-9."""
    q = p - 0.5
    middle = q * _horner(q * q, ACKLAM_A) / _horner(q * q, ACKLAM_B)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(t, ACKLAM_C) / _horner(t, ACKLAM_D)
    return F.when(p < ACKLAM_TAIL, tail).when(p > 1 - ACKLAM_TAIL, -tail).otherwise(middle)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, stepped back by the recurrence."""
    z = x.cast("double") + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    steps = F.lit(1.0)
    for i in range(8):
        steps = steps * (z - (8 - i))
    return series - F.log(steps)


LINKS: dict[str, tuple[Callable, Callable, Callable]] = {
    "identity": (lambda m: m, lambda e: e, lambda e, m: F.lit(1.0)),
    "log": (lambda m: F.log(_positive(m)), lambda e: F.exp(F.least(e, F.lit(_BIG))), lambda e, m: m),
    "logit": (lambda m: F.log(_probability(m) / (1 - _probability(m))), lambda e: _probability(1 / (1 + F.exp(-e))), lambda e, m: m * (1 - m)),
    "probit": (lambda m: normal_inverse(_probability(m)), lambda e: _probability(normal_cumulative(e)), lambda e, m: F.greatest(F.lit(_TINY), normal_density(e))),
    "inverse": (lambda m: 1 / m, lambda e: F.try_divide(F.lit(1.0), e), lambda e, m: -m * m),
    "inverse_squared": (lambda m: 1 / (m * m), lambda e: 1 / F.sqrt(_positive(e)), lambda e, m: -0.5 * m * m * m),
    "sqrt": (lambda m: F.sqrt(F.greatest(m, F.lit(0.0))), lambda e: e * e, lambda e, m: 2 * e),
}


# Compositions: arrays of positive parts.
def closure(parts: Column, to: float = 1.0) -> Column:
    """Parts scaled to a sum."""
    p = doubles(parts)
    s = total(p)
    return F.transform(p, lambda x: x * to / s)


def clr(parts: Column) -> Column:
    """Logs less their mean."""
    logs = F.transform(doubles(parts), lambda x: F.log(x))
    mean = total(logs) / F.size(logs)
    return F.transform(logs, lambda x: x - mean)


def clr_inverse(z: Column) -> Column:
    return closure(F.transform(doubles(z), lambda x: F.exp(x)))


def alr(parts: Column, reference: int = -1) -> Column:
    """Logs of ratios to one part (default the last), which is left out."""
    p = doubles(parts)
    ref = F.element_at(p, reference + 1 if reference >= 0 else reference)
    at = F.lit(reference) if reference >= 0 else F.size(p) + reference
    rest = F.filter(p, lambda x, i: i != at)
    return F.transform(rest, lambda x: F.log(x / ref))


def alr_inverse(z: Column, reference: int = -1) -> Column:
    e = F.transform(doubles(z), lambda x: F.exp(x))
    if reference == -1:
        return closure(F.concat(e, F.array(F.lit(1.0))))
    return closure(F.array_insert(e, reference + 1, F.lit(1.0)))


def helmert_basis(d: int) -> np.ndarray:
    """Orthonormal rows: part i + 1 against the mean of the parts before it."""
    rows = np.zeros((d - 1, d))
    for i in range(1, d):
        rows[i - 1, :i] = 1 / i
        rows[i - 1, i] = -1
        rows[i - 1] *= math.sqrt(i / (i + 1))
    return rows


def sbp_basis(signs: list[list[int]]) -> np.ndarray:
    """Orthonormal rows of a sequential binary partition, given as +1, -1 and 0 by part."""
    rows = []
    for s in np.asarray(signs):
        r, t = int((s > 0).sum()), int((s < 0).sum())
        if not r or not t:
            raise ValueError("every partition needs parts on both sides")
        rows.append(np.where(s > 0, 1 / r, np.where(s < 0, -1 / t, 0)) * math.sqrt(r * t / (r + t)))
    basis = np.array(rows)
    if not np.allclose(basis @ basis.T, np.eye(len(basis)), atol=1e-9):
        raise ValueError("the partitions are not sequential")
    return basis


def dot(values: Column, weights) -> Column:
    return total(F.zip_with(doubles(values), F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w))


def ilr(parts: Column, d: int, basis: np.ndarray | None = None) -> Column:
    basis = helmert_basis(d) if basis is None else basis
    logs = F.transform(doubles(parts), lambda x: F.log(x))
    return F.array(*[dot(logs, row) for row in basis])


def ilr_inverse(z: Column, d: int, basis: np.ndarray | None = None) -> Column:
    basis = helmert_basis(d) if basis is None else basis
    return closure(F.array(*[F.exp(dot(z, column)) for column in basis.T]))


def aitchison_inner(a: Column, b: Column) -> Column:
    return total(F.zip_with(clr(a), clr(b), lambda x, y: x * y))


def aitchison_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(clr(a), clr(b), lambda x, y: (x - y) * (x - y))))


def perturb(a: Column, b: Column) -> Column:
    return closure(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def power(a: Column, k: float) -> Column:
    return closure(F.transform(doubles(a), lambda x: F.pow(x, F.lit(float(k)))))


def largest(options: list[Column]) -> Column:
    """greatest() that takes a single column too."""
    return F.greatest(*options) if len(options) > 1 else options[0]


EPSILON = 1e-10


def approx_equal(a: Column, b: Column, tolerance: float = EPSILON) -> Column:
    return F.abs(a - b) < tolerance


def _guarded(x: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(x.cast("double"))


def guard_finite(x: Column) -> Column:
    """The column, or an error at NaN or infinity."""
    v = x.cast("double")
    return _guarded(x, F.isnan(v) | (F.abs(v) == math.inf), "a finite number expected")


def guard_positive(x: Column) -> Column:
    return _guarded(x, x <= 0, "a positive number expected")


def guard_probability(x: Column) -> Column:
    return _guarded(x, (x < 0) | (x > 1), "a probability expected")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over rows that have both; NULL with a constant side, where ``corr`` raises an error."""
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.sqrt(F.var_pop(F.when(both, a)) * F.var_pop(F.when(both, b))), F.lit(0.0)))


def dot_columns(names: list[str], weights) -> Column:
    """A weighted sum of columns."""
    out = F.lit(0.0)
    for c, w in zip(names, weights):
        out = out + F.col(c) * float(w)
    return out
