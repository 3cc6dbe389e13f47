"""Exact binomial and Poisson intervals without SciPy.

In columns: the chance S of k events or more is its first term times F, a sum of products of
simple ratios, and its slope in the logarithm of the parameter is k / F. F grows with the
parameter, so ln S is concave, and Newton steps from below rise to the bound without passing
it. Everything is a JVM expression. For single numbers: quantiles of the beta and gamma
distributions by bisection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0.0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return front * total
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 100_000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return 1.0 - front * h


def _bisect(cdf, p: float, low: float, high: float) -> float:
    for _ in range(400):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_cdf(a, b, x), p, 0.0, 1.0)


def chi2_quantile(p: float, dof: float) -> float:
    high = max(1.0, dof)
    while gamma_cdf(dof / 2, high / 2) < p:
        high *= 2
    return _bisect(lambda x: gamma_cdf(dof / 2, x / 2), p, 0.0, high)


def clopper_pearson(successes: int, trials: int, level: float = 0.95) -> tuple[float, float]:
    """Exact two-sided binomial interval."""
    if trials <= 0 or not 0 <= successes <= trials or not 0 < level < 1:
        raise ValueError("successes must lie within a positive number of trials")
    tail = (1 - level) / 2
    lower = 0.0 if successes == 0 else beta_quantile(tail, successes, trials - successes + 1)
    upper = 1.0 if successes == trials else beta_quantile(1 - tail, successes + 1, trials - successes)
    return lower, upper


def poisson_rate(events: int, hours: float, level: float = 0.95) -> tuple[float, float, float]:
    """Exact two-sided interval of a rate, and its one-sided upper bound."""
    if events < 0 or hours <= 0 or not 0 < level < 1:
        raise ValueError("events must not be negative, hours must be positive")
    tail = (1 - level) / 2
    lower = 0.0 if events == 0 else chi2_quantile(tail, 2 * events) / 2 / hours
    return lower, chi2_quantile(1 - tail, 2 * events + 2) / 2 / hours, chi2_quantile(level, 2 * events + 2) / 2 / hours


def _sum_of_products(ratio, terms: Column) -> Column:
    """1 + ratio(1) + ratio(1) ratio(2) + ... of ``terms`` ratios."""
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * ratio(j)
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    count = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(count, zero, step, lambda s: s["sum"])


#: ln x! less Stirling's x ln x - x + ln(2 pi x) / 2, for x up to 15; zero for none.
_SMALL = [0.0] + [math.lgamma(x + 1) - (x * math.log(x) - x + 0.5 * math.log(2 * math.pi * x)) for x in range(1, 16)]


def _stirling_rest(x: Column) -> Column:
    """What Stirling's formula lacks: a table, and the series from 16 on (to 1e-17)."""
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    return F.when(x < 16, F.get(F.array(*[F.lit(v) for v in _SMALL]), x.cast("int"))).otherwise(series)


def _log_factorial(x: Column) -> Column:
    """ln x! of a whole number x >= 1, at the same cost for any."""
    return x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + _stirling_rest(x)


def _log_choose(n: Column, k: Column) -> Column:
    """ln of the ways to choose k of n, 1 <= k < n; large terms are left out before they cancel."""
    k = F.least(k, n - k)
    r = n - k
    return -k * F.ln(k / n) - r * F.log1p(-k / n) + 0.5 * F.ln(n / (2 * math.pi * k * r)) + _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(r)


#: Newton steps; they stop moving after some ten.
STEPS = 60


def _rise(k: Column, first: Column, log_rest, spread, target: float) -> Column:
    """The logarithm u of the parameter at which ln S = ln ``target``, where
    S = exp(first + k u + log_rest(u)) * F and F = spread(u). Without log_rest and F, S is at
    least what it is, so that the start lies below."""
    start = (math.log(target) - first) / k

    def step(u: Column, _: Column) -> Column:
        more = spread(u)
        return u - (first + k * u + log_rest(u) + F.ln(more) - math.log(target)) * more / k

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def _tail_terms(n: Column) -> Column:
    """Terms after which a sum of falling ratios stands still: some ten deviations."""
    return F.ceil(14 * F.sqrt(n)).cast("long") + 60


def _binomial_bound(k: Column, n: Column, target: float) -> Column:
    """p with P(X >= k) = ``target`` in n trials, for 1 <= k <= n."""
    k, n = k.cast("double"), n.cast("double")
    first = F.when(k < n, _log_choose(n, k)).otherwise(0.0)
    odds = lambda u: F.exp(u) / -F.expm1(u)
    spread = lambda u: _sum_of_products(lambda j: (n - k - j + 1) / (k + j) * odds(u), F.least((n - k).cast("long"), _tail_terms(n)))
    rise = _rise(k, first, lambda u: F.when(n > k, (n - k) * F.ln(-F.expm1(u))).otherwise(0.0), spread, target)
    # With k = n there is one term, p ** n.
    return F.when(k == n, F.exp(math.log(target) / n)).otherwise(F.exp(rise))


def _poisson_bound(k: Column, target: float) -> Column:
    """The mean with P(X >= k) = ``target``, for k >= 1."""
    k = k.cast("double")
    first = -_log_factorial(k)
    rise = _rise(k, first, lambda u: -F.exp(u), lambda u: _sum_of_products(lambda j: F.exp(u) / (k + j), _tail_terms(k) + 20), target)
    return F.exp(rise)


def clopper_pearson_column(successes: Column, trials: Column, level: float = 0.95) -> Column:
    """struct<lower, upper>; null where there is no trial. By symmetry the upper bound is one
    minus the lower one of the failures."""
    if not 0 < level < 1:
        raise ValueError("the level lies between 0 and 1")
    tail, k, n = (1 - level) / 2, successes.cast("long"), trials.cast("long")
    low = lambda x: F.when(x == 0, 0.0).otherwise(_binomial_bound(F.greatest(x, F.lit(1)), n, tail))
    good = (n > 0) & k.between(0, n)
    return F.when(good, F.struct(low(k).alias("lower"), (1 - low(n - k)).alias("upper"))).otherwise(F.struct(F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")))


def poisson_column(events: Column, hours: Column, level: float = 0.95) -> Column:
    """struct<lower, upper, one_sided_upper>; null where there is no exposure."""
    if not 0 < level < 1:
        raise ValueError("the level lies between 0 and 1")
    tail, k = (1 - level) / 2, events.cast("long")
    lower = F.when(k == 0, 0.0).otherwise(_poisson_bound(F.greatest(k, F.lit(1)), tail))
    bounds = (lower, _poisson_bound(k + 1, 1 - tail), _poisson_bound(k + 1, level))
    good = (hours > 0) & (k >= 0)
    return F.struct(*[F.when(good, b / hours).alias(n) for b, n in zip(bounds, ("lower", "upper", "one_sided_upper"), strict=True)])


def window_probability(rate_per_hour: Column, seconds: float) -> Column:
    """Chance of one event or more in a window."""
    return 1 - F.exp(-rate_per_hour * seconds / 3600)
