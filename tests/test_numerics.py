import math

import pytest
from pyspark.sql import functions as F

from tillsight.functions import numerics as nx
from tillsight.operators import stats


def closed_form(r, n):
    """Two-sided p for 1, 2, 3 and 4 degrees of freedom."""
    r = abs(r)
    return {
        3: 1 - 2 / math.pi * math.asin(r),
        4: 1 - r,
        5: 1 - 2 / math.pi * (math.asin(r) + r * math.sqrt(1 - r * r)),
        6: 1 - r * (3 - r * r) / 2,
    }[n]


def test_correlation_p_equals_closed_forms(spark):
    rows = [(r, n) for n in (3, 4, 5, 6) for r in (-0.999999, -0.5, -0.01, 1e-7, 0.2, 0.7, 0.95, 0.9999)]
    df = spark.createDataFrame(rows, "r double, n long")
    for x in nx.with_correlation_p(df, "r", "n").collect():
        assert x.p_value == pytest.approx(closed_form(x.r, x.n), abs=1e-12, rel=1e-9)


def test_correlation_p_of_many_pairs_nears_the_normal_tail(spark):
    rows = [(z / math.sqrt(n), n) for n in (10**6, 10**9) for z in (0.1, 1.0, 3.0, 5.0)]
    df = spark.createDataFrame(rows, "r double, n long")
    for x in nx.with_correlation_p(df, "r", "n").collect():
        z = abs(x.r) * math.sqrt(x.n)
        assert x.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=300 / x.n + 1e-7)


def test_correlation_p_edges(spark):
    df = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.0, 9), (0.5, 2), (None, 9), (math.nan, 9)], "r double, n long")
    assert [x.p_value for x in nx.with_correlation_p(df, "r", "n").collect()] == [0.0, 0.0, 1.0, None, None, None]
    assert stats.pearson(df.limit(0), "r", "n").first().p_value is None


def test_gamma_half_step(spark):
    rows = [(a,) for a in (0.5, 1.0, 2.5, 10.0, 123.0)]
    got = spark.createDataFrame(rows, "a double").select("a", nx.log_gamma_half_step(F.col("a")).alias("v")).collect()
    for x in got:
        assert x.v == pytest.approx(math.lgamma(x.a + 0.5) - math.lgamma(x.a), abs=1e-12)
