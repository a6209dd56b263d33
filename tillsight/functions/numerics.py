"""Numeric column builders and the few scalar helpers the driver needs.

Everything that touches rows is a Column expression, so it stays inside Spark's
generated code; plain Python floats appear only for constants such as a
critical value.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of Hart's (1968) rational approximation of the
# normal tail as published by West (2005), highest power first.
HART_NUMERATOR = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
HART_DENOMINATOR = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
HART_SPLIT = 7.07106781186547
SQRT_TWO_PI = 2.506628274631


def _horner(x: Column, coefficients) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error near 1e-16."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    near = density * _horner(a, HART_NUMERATOR) / _horner(a, HART_DENOMINATOR)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    upper = F.when(a < HART_SPLIT, near).otherwise(density / fraction / SQRT_TWO_PI)
    return F.when(x.isNull(), None).when(x > 0, 1.0 - upper).otherwise(upper)


def with_two_sided_p(df: DataFrame, z: str, name: str = "p_value") -> DataFrame:
    """Add 2 * (1 - Phi(|z|)).

    Phi names its argument some thirty times, so |z| becomes a column of its
    own first; an inlined argument would multiply the size of the plan.
    """
    a = df.withColumn("_abs_z", F.abs(F.col(z)))
    return a.withColumn(name, 2.0 * (1.0 - normal_cdf(F.col("_abs_z")))).drop("_abs_z")


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: shift by eight, then four Stirling terms."""
    y = x + 8.0
    shift = x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    r = 1.0 / (y * y)
    series = (1.0 / 12.0 - r * (1.0 / 360.0 - r * (1.0 / 1260.0 - r / 1680.0))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2.0 * math.pi) + series - F.log(shift)


def log_gamma_array(x: np.ndarray) -> np.ndarray:
    """The same formula for NumPy arrays, used inside Arrow batches."""
    x = np.asarray(x, dtype=float)
    y = x + 8.0
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    r = 1.0 / (y * y)
    series = (1.0 / 12.0 - r * (1.0 / 360.0 - r * (1.0 / 1260.0 - r / 1680.0))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2.0 * math.pi) + series - np.log(shift)


# Coefficients of ln(Gamma(a + 1/2) / Gamma(a)) - ln(a) / 2 in 1/a, 1/a**3, 1/a**5, ...
HALF_STEP = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)


def log_gamma_half_step(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)) for a > 0: shift by eight, then an asymptotic series.

    Two log-gammas would lose all digits to cancellation where a is large.
    """
    y = a + 8.0
    shift = F.lit(1.0)
    for k in range(8):
        shift = shift * (1.0 + 0.5 / (a + float(k)))
    r = 1.0 / (y * y)
    return 0.5 * F.log(y) + _horner(r, HALF_STEP[::-1]) / y - F.log(shift)


#: Stands for zero in a continued fraction.
TINY = 1e-300


def beta_fraction(x: Column, a: Column, b: Column, terms: Column) -> Column:
    """Continued fraction of the incomplete beta function, by Lentz's method (DLMF 8.17.22).

    Converges fast for x < (a + 1) / (a + b + 2), in some sqrt(max(a, b)) terms.
    """

    def kept(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, TINY).otherwise(v)

    def turn(s: Column, factor: Column) -> Column:
        d = 1.0 / kept(1.0 + factor * s["d"])
        c = kept(1.0 + factor / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, k: Column) -> Column:
        # Even and odd factors take turns.
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return turn(s, x * F.when(k % 2 == 0, even).otherwise(odd))

    first = 1.0 / kept(1.0 - (a + b) / (a + 1.0) * x)
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(2), terms.cast("int")), start, step, lambda s: s["h"])


def with_correlation_p(df: DataFrame, r: str, n: str, name: str = "p_value") -> DataFrame:
    """Add the exact two-sided p-value of a correlation `r` of `n` pairs.

    With nu = n - 2 it is the regularised incomplete beta function at 1 - r*r
    for nu/2 and 1/2, or one minus its mirror where that converges faster. Null
    for fewer than three pairs, zero for |r| = 1.
    """
    nu, r2 = F.col("_a") * 2.0, F.col("_r2")
    a, half, x = F.col("_a"), F.lit(0.5), 1.0 - F.col("_r2")
    front = F.exp(a * F.log1p(-r2) + 0.5 * F.log(r2) + log_gamma_half_step(a) - 0.5 * math.log(math.pi))
    mirrored = x > (a + 1.0) / (a + 2.5)
    parts = (
        df.withColumn("_a", F.when(F.col(n) > 2, (F.col(n) - 2).cast("double") / 2.0))
        .withColumn("_r2", F.col(r) * F.col(r))
        .withColumn("_front", front)
        .withColumn("_terms", F.ceil(8.0 * F.sqrt(nu)) + 80)
        .withColumn("_x", F.when(mirrored, r2).otherwise(x))
        .withColumn("_p", F.when(mirrored, half).otherwise(a))
        .withColumn("_q", F.when(mirrored, a).otherwise(half))
    )
    part = F.col("_front") * beta_fraction(F.col("_x"), F.col("_p"), F.col("_q"), F.col("_terms")) / F.col("_p")
    value = F.when(mirrored, 1.0 - part).otherwise(part)
    exact = F.when(a.isNull() | F.col(r).isNull() | F.isnan(r), None).when(r2 >= 1.0, 0.0).when(r2 == 0.0, 1.0)
    helpers = ("_a", "_r2", "_front", "_terms", "_x", "_p", "_q")
    return parts.withColumn(name, exact.otherwise(value)).drop(*helpers)


def hyp2f1(a: Column, b: Column, c: Column, z: Column, terms: int) -> Column:
    """Gauss series for 0 <= z < 1 with a fixed number of terms."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        k = k.cast("double")
        term = acc["term"] * (a + k) * (b + k) / ((c + k) * (k + 1.0)) * z
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step, lambda acc: acc["total"])


MAX_ARGUMENT = 0.99


def series_terms(z_max: float, floor: int = 40, tolerance: float = 1e-13) -> int:
    """Terms the Gauss series needs when its argument never exceeds `z_max`.

    The number grows without bound as the argument nears 1. Beyond MAX_ARGUMENT
    it would take over 3,000 terms a row; that is an error, not a shorter series.
    """
    if z_max <= 0.0:
        return floor
    if z_max > MAX_ARGUMENT:
        raise ValueError(f"series argument {z_max} above {MAX_ARGUMENT}: forecast fewer days ahead")
    return max(floor, int(math.ceil(math.log(tolerance) / math.log(z_max) * 1.3)) + 20)


def exact_sum(x: Column) -> Column:
    """Sum of a money column that does not depend on the order of the rows."""
    return F.sum(x.cast("decimal(18,4)")).cast("double")


def round_half_up(x: Column, digits: int) -> Column:
    """Round as a decimal, so 100803.975 held as 100803.97499... goes up."""
    return F.round(x.cast("decimal(28,8)"), digits).cast("double")


def hash_uniform(seed, *keys: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an md5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
