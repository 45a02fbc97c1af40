"""Closed-form statistics as Column expressions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normal quantile of a 95 % interval, and the polynomial of erf (Abramowitz and Stegun 7.1.26).
Z95 = 1.959963984540054
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def count_where(condition: Column) -> Column:
    """COUNT(*) FILTER (WHERE condition): a null condition counts as false."""
    return F.count(F.when(condition, 1))


def avg_where(condition: Column, value: Column) -> Column:
    """AVG(value) FILTER (WHERE condition); null if no row fits."""
    return F.avg(F.when(condition, value.cast("double")))


def rate(part: Column, whole: Column) -> Column:
    """part / whole as double; null where whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(odds_ratio, ci_low, ci_high, corrected) of the 2x2 table a b / c d.

    If any cell is 0, 0.5 is added to all four (corrected); the interval is the 95 % one of the logarithm."""
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    fix = F.when(zero, 0.5).otherwise(0.0)
    a, b, c, d = (x.cast("double") + fix for x in (a, b, c, d))
    ratio = (a * d) / (b * c)
    half = Z95 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.struct(ratio.alias("odds_ratio"), F.exp(F.log(ratio) - half).alias("ci_low"), F.exp(F.log(ratio) + half).alias("ci_high"), zero.alias("corrected"))


def contingency(exposed: Column, outcome: Column) -> tuple[Column, Column, Column, Column]:
    """Aggregates a, b, c, d: exposed with and without the outcome, then not exposed; nulls in either are left out."""
    known = exposed.isNotNull() & outcome.isNotNull()
    return (count_where(exposed & outcome), count_where(exposed & ~outcome), count_where(known & ~exposed & outcome), count_where(known & ~exposed & ~outcome))


def pearson(x: Column, y: Column) -> tuple[Column, Column]:
    """Aggregates: the number of pairs and their clamped correlation.

    Pairs with a null are left out; the correlation is null under four pairs or where a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n, spread = F.count(x), F.stddev_pop(x) * F.stddev_pop(y)
    # corr() itself divides by zero where a side does not vary
    r = F.covar_pop(x, y) / F.when(spread > 0, spread)
    return n, F.when((n >= 4) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fisher_interval(r: Column, n: Column) -> Column:
    """struct(low, high): Fisher's 95 % interval of a correlation; (r, r) where it is 1 in size."""
    half = Z95 / F.sqrt((n - 3).cast("double"))
    exact = F.abs(r) >= 1.0
    inner = F.when(exact, 0.0).otherwise(r)
    low, high = F.tanh(F.atanh(inner) - half), F.tanh(F.atanh(inner) + half)
    return F.when(r.isNotNull(), F.struct(F.when(exact, r).otherwise(low).alias("low"), F.when(exact, r).otherwise(high).alias("high")))


def erf(x: Column) -> Column:
    """The error function by a polynomial of five terms."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    y = 1.0 - poly * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """struct(z, p): the pooled two-proportion test. p takes the size of z alone; (0, 0.5) where a side is empty or the
    pooled variance is 0."""
    x1, n1, x2, n2 = (c.cast("double") for c in (x1, n1, x2, n2))
    empty = (n1 <= 0) | (n2 <= 0)
    m1, m2 = F.when(empty, 1.0).otherwise(n1), F.when(empty, 1.0).otherwise(n2)
    pooled = (x1 + x2) / (m1 + m2)
    variance = pooled * (1 - pooled) * (1 / m1 + 1 / m2)
    none = empty | (variance <= 0)
    z = F.when(none, 0.0).otherwise((x1 / m1 - x2 / m2) / F.sqrt(F.when(none, 1.0).otherwise(variance)))
    return F.struct(z.alias("z"), F.when(none, 0.5).otherwise((1 - erf(F.abs(z) / F.sqrt(F.lit(2.0)))) / 2).alias("p"))


def unit(x: Column) -> Column:
    """x clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
