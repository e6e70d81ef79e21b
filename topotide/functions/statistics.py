"""Tail probabilities as column expressions: Student's t, and permutation tests of 0/1 patterns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: The argument is raised so far before the series is used.
RAISED = 10
_TINY = 1e-300


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of values that are computed once, however often ``f`` uses them."""
    names = [f"v{i}" for i in range(len(values))]
    one = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.transform(one, lambda s: f(*[s[n] for n in names]))[0]


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, to about 1e-12."""
    up = x + RAISED
    below = x
    for i in range(1, RAISED):
        below = below * (x + i)
    series = F.lit(0.0)
    for i, c in enumerate(STIRLING):
        series = series + F.lit(c) / F.pow(up, F.lit(2.0 * i + 1))
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - F.ln(below)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 <= x <= 1, by its continued fraction.

    The fraction is taken on the side of the mean on which it converges, with
    a number of terms that grows with the root of the larger parameter.
    """
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    row = F.struct(p.alias("p"), q.alias("q"), z.alias("z"))
    guarded = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(s: Column, i: Column) -> Column:
        p, q, z, m = s["p"], s["q"], s["z"], i.cast("double")
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 / guarded(1 + even * s["d"])
        c = guarded(1 + even / s["c"])
        d2 = 1 / guarded(1 + odd * d)
        c2 = guarded(1 + odd / c)
        return F.struct(p.alias("p"), q.alias("q"), z.alias("z"), c2.alias("c"), d2.alias("d"), (s["h"] * d * c * d2 * c2).alias("h"))

    first = 1 / guarded(1 - (row["p"] + row["q"]) * row["z"] / (row["p"] + 1))
    start = F.struct(row["p"].alias("p"), row["q"].alias("q"), row["z"].alias("z"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    terms = F.sequence(F.lit(1), (F.lit(40) + 3 * F.ceil(F.sqrt(F.greatest(p, q)))).cast("int"))
    fraction = F.aggregate(terms, start, step, lambda s: s["h"])
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(F.greatest(z, F.lit(_TINY))) + q * F.ln(F.greatest(1 - z, F.lit(_TINY))))
    value = F.least(F.lit(1.0), front * fraction / p)
    inside = F.when(swap, 1 - value).otherwise(value)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t with ``df`` degrees of freedom; null where df is below 1."""
    return F.when(df >= 1, incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5)))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson r of the pairs without nulls; NaN where a side has no spread, null where there are no pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread == 0, float("nan")).otherwise(F.covar_pop(a, b) / spread)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n pairs: null below three pairs, 0 for a perfect one."""
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(_TINY)))
    return F.when(n >= 3, F.when(F.abs(r) >= 1, 0.0).otherwise(t_tail(t, n - 2)))


def student_tail(t: float, df: float) -> float:
    """``t_tail`` of plain numbers, for small solves inside a group."""
    if df < 1:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = (b, a, 1 - x) if swap else (a, b, x)
    c, d = 1.0, 1 / ((1 - (p + q) * z / (p + 1)) or _TINY)
    h = d
    for m in range(1, 41 + 3 * math.ceil(math.sqrt(max(p, q)))):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / ((1 + term * d) or _TINY)
            c = (1 + term / c) or _TINY
            h *= d * c
    value = h / p * math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(z) + q * math.log1p(-z))
    return 1 - value if swap else value


def coin_heads(n: Column, *seeds: Column) -> Column:
    """Heads among n fair coins, which are the bits of hashes of the seeds: 64 to a hash."""
    words = F.sequence(F.lit(0).cast("bigint"), F.greatest((n + 63).cast("bigint") / 64 - 1, F.lit(0)).cast("bigint"))
    left = lambda i: n.cast("bigint") - i * 64
    coins = lambda i: F.when(left(i) >= 64, F.xxhash64(*seeds, i)).otherwise(F.call_function("shiftrightunsigned", F.xxhash64(*seeds, i), (64 - left(i)).cast("int")))
    return F.when(n > 0, F.aggregate(words, F.lit(0).cast("bigint"), lambda s, i: s + F.bit_count(coins(i)))).otherwise(F.lit(0).cast("bigint"))


def two_sample_p(n: Column, ones: Column, others: Column) -> Column:
    """Exact permutation p of two 0/1 samples of n each with ``ones`` and ``others`` ones.

    Of all ways to deal the pooled values into two halves, the share whose
    difference is at least the one seen: a hypergeometric tail, from its first
    term on by ratios.
    """
    return bound(_two_sample_p, n.cast("double"), ones.cast("double"), others.cast("double"))


def _two_sample_p(n: Column, a: Column, b: Column) -> Column:
    choose = lambda m, k: log_gamma(m + 1) - log_gamma(k + 1) - log_gamma(m - k + 1)

    def tail(n: Column, high: Column, total: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            x = high + i - 1
            t = s["t"] * (total - x) * (n - x) / ((x + 1) * (n - total + x + 1))
            return F.struct(t.alias("t"), (s["sum"] + t).alias("sum"))

        def summed(first: Column, more: Column) -> Column:
            terms = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(terms, F.struct(first.alias("t"), first.alias("sum")), step, lambda s: s["sum"])

        return bound(summed, F.exp(choose(total, high) + choose(2 * n - total, n - high) - choose(2 * n, n)), (F.least(n, total) - high).cast("int"))

    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), 2 * bound(tail, n, F.greatest(a, b), a + b)))


def dealt_p(n: Column, ones: Column, others: Column, replicates: int, *seeds: Column) -> Column:
    """``two_sample_p`` estimated: the pooled values are dealt out ``replicates`` times, by hashes of the seeds."""
    unit = lambda *c: (F.xxhash64(*seeds, *c).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    gap, total = F.abs(ones - others), ones + others

    def dealt(r: Column) -> Column:
        def draw(s: Column, i: Column) -> Column:
            hit = (unit(r, i) * (2 * s["n"] - i) < s["left"]).cast("bigint")
            return F.struct(s["n"].alias("n"), (s["left"] - hit).alias("left"), (s["got"] + hit).alias("got"))

        start = F.struct(n.cast("bigint").alias("n"), total.cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("got"))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), start, draw, lambda s: s["got"])

    at_least = lambda s, r: s + F.when(F.abs(2 * dealt(r) - total) >= gap, 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(replicates)), F.lit(0), at_least) / replicates


def random_pattern_p(n: Column, ones: Column) -> Column:
    """Mean of ``two_sample_p`` over all random patterns of n fair coins: how well chance explains a pattern with ``ones`` ones.

    Every number of heads counts with its binomial weight, so the terms are
    about n squared; ``sampled_pattern_p`` takes a few patterns instead.
    """
    m = n.cast("double")
    weight = lambda k: F.exp(log_gamma(m + 1) - log_gamma(k + 1) - log_gamma(m - k + 1) - m * math.log(2))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint")), F.lit(0.0), lambda s, k: s + weight(k.cast("double")) * two_sample_p(n, ones, k))


def sampled_pattern_p(n: Column, ones: Column, draws: int, *seeds: Column) -> Column:
    """Mean of ``two_sample_p`` over ``draws`` patterns of coins by hashes of the seeds."""
    each = lambda d: two_sample_p(n, ones, coin_heads(n, *seeds, d))
    return F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0.0), lambda s, d: s + each(d)) / draws
