"""Distribution tails as Column expressions (Spark has no erf / gamma built in).

Everything stays inside the JVM and whole-stage codegen; result tables that need a p-value
get it as one more column instead of a driver round trip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT2 = math.sqrt(2.0)
SQRT_PI = math.sqrt(math.pi)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def erfc(x) -> Column:
    """erfc for any real x with relative accuracy in the tail: the power series of erf below 2.5, the continued
    fraction x + (1/2)/(x + (2/2)/(x + ...)) beyond (backward from the 60th term); erfc(-x) = 2 - erfc(x)."""
    x = _c(x).cast("double")
    ax = F.abs(x)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")),
        lambda acc, n: F.struct(
            (acc["s"] - acc["t"] * ax * ax / n / (2 * n + 1)).alias("s"),
            (-acc["t"] * ax * ax / n).alias("t"),
        ),
    )["s"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), ax, lambda f, k: ax + k / 2.0 / f)
    pos = F.when(ax < 2.5, 1.0 - 2.0 / SQRT_PI * ax * series).otherwise(F.exp(-ax * ax) / SQRT_PI / fraction)
    return F.when(x.isNull(), None).when(x >= 0, pos).otherwise(2.0 - pos)


def normal_sf(z) -> Column:
    """P(Z > z) for the standard normal."""
    return 0.5 * erfc(_c(z) / SQRT2)


def normal_cdf(z) -> Column:
    return 0.5 * erfc(-_c(z) / SQRT2)


def two_sided_p(z) -> Column:
    """2·P(Z > |z|)."""
    return erfc(F.abs(_c(z)) / SQRT2)


def chi2_sf(x, df) -> Column:
    """Upper tail of the χ² distribution with integer df ≥ 1.

    even df: e^{-x/2} Σ_{i<df/2} (x/2)^i / i!
    odd df:  erfc(√(x/2)) + e^{-x/2} Σ_{i=1}^{(df-1)/2} (x/2)^{i-½} / Γ(i+½)
    The series is accumulated term by term with a higher-order ``aggregate``.
    """
    x = _c(x).cast("double")
    df = _c(df).cast("int")
    h = x / 2.0
    even_n = (df / 2).cast("int")  # number of terms for even df: i = 0..n-1
    odd_n = ((df - 1) / 2).cast("int")  # terms i = 1..n for odd df
    empty = F.array().cast("array<int>")

    even_seq = F.when(even_n >= 2, F.sequence(F.lit(1), even_n - 1)).otherwise(empty)
    even_sum = F.aggregate(
        even_seq,
        F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")),
        lambda acc, i: F.struct(
            (acc["s"] + acc["t"] * h / i).alias("s"),
            (acc["t"] * h / i).alias("t"),
        ),
    )["s"]
    even_tail = F.exp(-h) * even_sum

    first_odd = F.sqrt(h) / (SQRT_PI / 2.0)  # (x/2)^{1/2} / Γ(3/2)
    odd_seq = F.when(odd_n >= 2, F.sequence(F.lit(2), odd_n)).otherwise(empty)
    odd_sum = F.aggregate(
        odd_seq,
        F.struct(first_odd.alias("s"), first_odd.alias("t")),
        lambda acc, i: F.struct(
            (acc["s"] + acc["t"] * h / (i - 0.5)).alias("s"),
            (acc["t"] * h / (i - 0.5)).alias("t"),
        ),
    )["s"]
    odd_tail = erfc(F.sqrt(h)) + F.exp(-h) * F.when(odd_n >= 1, odd_sum).otherwise(F.lit(0.0))

    return (
        F.when(x.isNull() | df.isNull() | (df < 1), None)
        .when(x <= 0, F.lit(1.0))
        .when(df % 2 == 0, even_tail)
        .otherwise(odd_tail)
    )


def chi2_pdf(x, df) -> Column:
    """Density of the χ² distribution with integer df ≥ 1 at x > 0: x^{df/2−1} e^{−x/2} / (2^{df/2} Γ(df/2)), with the
    logarithm of Γ from its recurrence over halves."""
    x, df = _c(x).cast("double"), _c(df).cast("int")
    start = F.when(df % 2 == 0, F.lit(0.0)).otherwise(F.lit(math.log(SQRT_PI)))  # ln Γ(1), ln Γ(1/2)
    first = F.when(df % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    steps = F.when(df >= 3, F.sequence(F.lit(0), ((df - 1) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    log_gamma = F.aggregate(steps, start, lambda acc, i: acc + F.log(first + i))
    half = df / 2.0
    return F.exp((half - 1) * F.log(x) - x / 2 - half * math.log(2.0) - log_gamma)


def chi2_quantile(p, df) -> Column:
    """x with P(X ≤ x) = p for the χ² distribution with integer df ≥ 1 and 0 < p < 1 (0 at p ≤ 0, null at p ≥ 1): the
    upper tail halves an interval that holds the root 40 times, then eight Newton steps on it, kept in the interval."""
    p, df = _c(p).cast("double"), _c(df).cast("int")
    tail = 1 - p
    top = df + 4 * F.sqrt(-2.0 * df * F.log(tail)) - 4 * F.log(tail) + 10

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        left = chi2_sf(mid, df) < tail  # the root is below the middle
        return F.struct(F.when(left, acc["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(acc["hi"]).alias("hi"))

    box = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0.0).alias("lo"), top.alias("hi")), halve)

    def newton(x, _):
        better = x + (chi2_sf(x, df) - tail) / chi2_pdf(x, df)
        return F.when(better > 0, better).otherwise(x / 2)

    root = F.aggregate(F.sequence(F.lit(1), F.lit(8)), (box["lo"] + box["hi"]) / 2, newton)
    return F.when(p.isNull() | df.isNull() | (df < 1) | (p >= 1), None).when(p <= 0, F.lit(0.0)).otherwise(root)


def z_crit(level: float = 0.95) -> float:
    """Two-sided normal critical value for a confidence level (driver-side constant)."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(0.5 + level / 2.0)
