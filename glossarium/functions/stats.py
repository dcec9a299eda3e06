"""Association, interval and agreement statistics on columns, in closed form or by bisection inside Catalyst."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 97.5 % normal quantile, and the chi-square thresholds of one degree of freedom.
Z = 1.959963984540054
Z_ROUND = 1.96
STARS = ((10.828, "***"), (6.635, "**"), (3.841, "*"))


def haldane(cells: list[Column]) -> list[Column]:
    """The cells as doubles; half a count is added to all of them if any is zero."""
    add = F.when(F.least(*cells) == 0, 0.5).otherwise(0.0)
    return [c.cast("double") + add for c in cells]


def log_odds_ratio(cells: list[Column]) -> Column:
    a, b, c, d = haldane(cells)
    return F.ln(a * d / (b * c))


def log_odds_error(cells: list[Column]) -> Column:
    a, b, c, d = haldane(cells)
    return F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _margins(cells: list[Column]) -> tuple[Column, list[tuple[Column, Column]]]:
    """(total, [(observed, expected)]) of a table a=cue&outcome, b=outcome only, c=cue only, d=neither."""
    a, b, c, d = (x.cast("double") for x in cells)
    n = a + b + c + d
    return n, [(a, (a + b) * (a + c) / n), (b, (a + b) * (b + d) / n), (c, (c + d) * (a + c) / n), (d, (c + d) * (b + d) / n)]


def g_squared(cells: list[Column]) -> Column:
    """Dunning's likelihood ratio of a 2x2 table; 0 where a margin is empty."""
    _, pairs = _margins(cells)
    total = sum((F.when(o > 0, o * F.ln(o / e)).otherwise(0.0) for o, e in pairs), F.lit(0.0))
    return F.when(F.least(*(e for _, e in pairs)) > 0, 2 * total).otherwise(0.0)


def least_expected(cells: list[Column]) -> Column:
    _, pairs = _margins(cells)
    return F.least(*(e for _, e in pairs))


def three_way_g_squared(first: list[Column], second: list[Column], steps: int = 80) -> Column:
    """Deviance of the log-linear model without the three-way term.  The fitted tables are first + s.x and second - s.x
    with s = (+,-,-,+): all two-way margins are kept, and x, where both odds ratios agree, is found by bisection."""
    p, q = haldane(first), haldane(second)
    low = F.greatest(-p[0], -p[3], -q[1], -q[2])
    high = F.least(p[1], p[2], q[0], q[3])

    def gap(x: Column) -> Column:
        return F.ln((p[0] + x) * (p[3] + x) / ((p[1] - x) * (p[2] - x))) - F.ln((q[0] - x) * (q[3] - x) / ((q[1] + x) * (q[2] + x)))

    def halve(span: Column, _: Column) -> Column:
        mid = (span["low"] + span["high"]) / 2
        up = gap(mid) > 0
        return F.struct(F.when(up, span["low"]).otherwise(mid).alias("low"), F.when(up, mid).otherwise(span["high"]).alias("high"))

    span = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.alias("low"), high.alias("high")), halve)
    x = (span["low"] + span["high"]) / 2
    sign = (1, -1, -1, 1)
    fitted = [o + s * x for o, s in zip(p, sign)] + [o - s * x for o, s in zip(q, sign)]
    return 2 * sum((o * F.ln(o / e) for o, e in zip(p + q, fitted)), F.lit(0.0))


def wilson(k: Column, n: Column, upper: bool) -> Column:
    """A bound of the Wilson interval of k in n, within [0, 1]; null for n = 0."""
    z, share = Z_ROUND, k / n
    middle = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.least(F.lit(1.0), middle + half) if upper else F.greatest(F.lit(0.0), middle - half))


def paired_log_ratio(b: Column, c: Column) -> Column:
    add = F.when((b == 0) | (c == 0), 0.5).otherwise(0.0)
    return F.ln((b + add) / (c + add))


def paired_g_squared(b: Column, c: Column) -> Column:
    m = (b + c) / 2.0
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return F.when(b + c > 0, 2 * (part(b) + part(c))).otherwise(0.0)


def stars(g: Column) -> Column:
    out = F.lit("")
    for least, mark in reversed(STARS):
        out = F.when(g >= least, mark).otherwise(out)
    return out


def upper_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of a binomial X with n trials, summed term by term; for the short lists of words.  1 for p >= 1."""

    def add(acc: Column, i: Column) -> Column:
        term = F.when(i == 0, acc["term"]).otherwise(acc["term"] * (n - i + 1) / F.greatest(i, F.lit(1)) * p / (1 - p))
        return F.struct(term.alias("term"), (acc["total"] + F.when(i >= k, term).otherwise(0.0)).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0), n), F.struct(F.pow(1 - p, n).alias("term"), F.lit(0.0).alias("total")), add)["total"]
    return F.when(p >= 1, 1.0).otherwise(total)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction, whose length grows with the root of a + b."""
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for j in range(1, 60 + 4 * math.isqrt(int(a + b))):
        m = (j + 1) // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if j % 2 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + term * d), 1 + term / c
        h *= c * d
    return front * h


def exact_odds(b: int, c: int, upper: bool) -> float:
    """A bound of the exact 95 % interval of the odds b : c (Clopper and Pearson's on b of b + c); 0 and infinite where
    nothing is discordant or one side is empty."""
    if (c if upper else b) == 0:
        return math.inf if upper else 0.0
    one, two, level = (b + 1, c, 0.975) if upper else (b, c + 1, 0.025)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_share(one, two, mid) < level else (low, mid)
    return mid / (1 - mid)


def paired_odds_bound(b: Column, c: Column, upper: bool) -> Column:
    """exact_odds on columns of counts, which are aggregates already: few rows reach Python.  Null for null counts."""

    @F.pandas_udf("double")
    def bound(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([exact_odds(int(i), int(j), upper) if i == i and j == j else None for i, j in zip(x, y)], dtype="float64")

    return bound(b, c)


def exact_binomial(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c under even chances: twice the smaller tail, 1 at most and where nothing is
    discordant.  By the continued fraction, so that counts of any size take no more than its length; null for null."""

    @F.pandas_udf("double")
    def p(x: pd.Series, y: pd.Series) -> pd.Series:
        tail = lambda i, j: _beta_share(max(i, j), min(i, j) + 1, 0.5) if i != j else 0.5
        return pd.Series([min(1.0, 2 * tail(int(i), int(j))) if i == i and j == j else None for i, j in zip(x, y)], dtype="float64")

    return p(b, c)
