"""Special functions and distributions in plain Python, for driver-side use and inside Arrow functions."""

from __future__ import annotations

import math

EPS = 1e-15


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * EPS:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < EPS:
            break
    return max(0.0, 1 - scale * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    tiny = 1e-300
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        step = 1.0
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            step = c * d
            h *= step
        if abs(step - 1) < EPS:
            break
    return front * h


def solve(cdf, p: float, low: float, high: float) -> float:
    """The x with cdf(x) = p between low and high, by bisection to double precision."""
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def normal_pdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    z = (x - mean) / sd
    return math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc((mean - x) / (sd * math.sqrt(2)))


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    if not 0 <= p <= 1:
        raise ValueError("a probability lies between 0 and 1")
    if p in (0, 1):
        return math.inf if p else -math.inf
    return mean + sd * solve(normal_cdf, p, -39.0, 39.0)


def uniform_pdf(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return 1 / (high - low) if low <= x <= high else 0.0


def uniform_cdf(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return min(1.0, max(0.0, (x - low) / (high - low)))


def uniform_quantile(p: float, low: float = 0.0, high: float = 1.0) -> float:
    return low + p * (high - low)


def gamma_pdf(x: float, shape: float, scale: float = 1.0) -> float:
    if x < 0 or (x == 0 and shape > 1):
        return 0.0
    if x == 0:
        return 1 / scale if shape == 1 else math.inf
    return math.exp((shape - 1) * math.log(x / scale) - x / scale - math.lgamma(shape)) / scale


def gamma_cdf(x: float, shape: float, scale: float = 1.0) -> float:
    return gamma_p(shape, x / scale)


def gamma_quantile(p: float, shape: float, scale: float = 1.0) -> float:
    top = shape + 10 * math.sqrt(shape) + 50
    while gamma_p(shape, top) < p < 1:
        top *= 2
    return math.inf if p >= 1 else scale * solve(lambda x: gamma_p(shape, x), p, 0.0, top)


def beta_pdf(x: float, a: float, b: float) -> float:
    if not 0 < x < 1:
        return 0.0
    return math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def beta_cdf(x: float, a: float, b: float) -> float:
    return beta_i(a, b, x)


def beta_quantile(p: float, a: float, b: float) -> float:
    return solve(lambda x: beta_i(a, b, x), p, 0.0, 1.0)


def chisq_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def chisq_quantile(p: float, df: float) -> float:
    return gamma_quantile(p, df / 2, 2.0)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    top = 10.0
    while t_cdf(top, df) < max(p, 1 - p) < 1:
        top *= 2
    return solve(lambda x: t_cdf(x, df), p, -top, top)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def binomial_log(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
