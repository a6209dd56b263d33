import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillsight.operators import experiments as ex
from tillsight.operators import ranking, stats

TEST = "metric_type string, count_c double, count_t double, mean_c double, mean_t double, variance_c double, variance_t double"


def one(spark, *row):
    return ex.run_tests(spark.createDataFrame([row], TEST)).first()


def test_two_proportions(spark):
    r = one(spark, "binary", 10000.0, 10000.0, 0.10, 0.115, None, None)
    assert r.z == pytest.approx(3.424269, abs=1e-6)
    assert r.p_value == pytest.approx(0.000616455, abs=1e-8)
    assert (r.ci_low, r.ci_high) == pytest.approx((0.006417, 0.023583), abs=1e-6)


def test_interval_width(spark):
    r = one(spark, "binary", 100000.0, 100000.0, 0.20, 0.21, None, None)
    assert r.ci_low < r.abs_effect < r.ci_high and r.ci_high - r.ci_low < 0.02


def test_welch(spark):
    same = one(spark, "continuous", 5000.0, 5000.0, 10.0, 10.0, 4.0, 4.0)
    assert same.p_value > 0.9 and abs(same.abs_effect) < 1e-9
    apart = one(spark, "continuous", 5000.0, 5000.0, 10.0, 10.5, 4.0, 4.0)
    assert apart.p_value < 0.05 and apart.z == pytest.approx(12.5)


def test_dispatch(spark):
    assert one(spark, "binary", 1000.0, 1000.0, 0.1, 0.12, None, None).z == pytest.approx(1.429301, abs=1e-6)
    assert one(spark, "continuous", 1000.0, 1000.0, 5.0, 5.2, 2.0, 2.1).z == pytest.approx(3.123475, abs=1e-6)


def test_empty_arm_raises(spark):
    with pytest.raises(PySparkException, match="(?i)zero"):
        one(spark, "binary", 0.0, 0.0, 0.0, 0.0, None, None)


def test_degenerate_rows(spark):
    r = one(spark, "continuous", 10.0, 10.0, 0.0, 0.0, 0.0, 0.0)
    assert (r.z, r.p_value, r.rel_effect) == (0.0, 1.0, None)


def test_unknown_metric_raises(spark):
    with pytest.raises(PySparkException, match="unknown metric_id 9"):
        ex.add_metric_type(spark.createDataFrame([(9,)], "metric_id int")).collect()


def bh(p):
    p = np.asarray(p)
    order = np.argsort(p)
    q = p[order] * len(p) / (1 + np.arange(len(p)))
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out


@pytest.mark.parametrize("seed", [None, 1])
def test_benjamini_hochberg(spark, seed):
    if seed is None:
        p = [0.01, 0.02, 0.03, 0.04, 0.05]
    else:
        p = np.round(np.random.default_rng(seed).beta(0.5, 2, 300), 2).tolist()
    df = spark.createDataFrame([(i, "ab"[i % 2], float(v)) for i, v in enumerate(p)], "i int, g string, p_value double")
    got = {r.i: r.p_adj for r in ex.benjamini_hochberg(df).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(p))], bh(p), atol=1e-12)
    grouped = {r.i: r.p_adj for r in ex.benjamini_hochberg(df, group=["g"]).collect()}
    for g in (0, 1):
        ids = list(range(g, len(p), 2))
        np.testing.assert_allclose([grouped[i] for i in ids], bh([p[i] for i in ids]), atol=1e-12)


def series(spark, effects, m=2):
    rows = [("e", 1, m, float(t), float(v)) for t, v in enumerate(effects)]
    return spark.createDataFrame(rows, "experiment_id string, variant_id int, metric_id int, time_since_start double, abs_effect double")


def test_stability(spark):
    assert ex.stability_flags(series(spark, [1, 2, 3, 4])).count() == 0
    r = ex.stability_flags(series(spark, [-1, 2, 3, 4, 5])).first()
    assert (r.n_snapshots, r.final_effect, r.mid_effect) == (5, 5.0, 3.0)
    assert not r.sign_flip_after_early_period and not r.large_drift_mid_to_final
    r = ex.stability_flags(series(spark, [1, -2, 1, 4, 9])).first()
    assert r.sign_flip_after_early_period and r.large_drift_mid_to_final
    r = ex.stability_flags(series(spark, [1, 2, 3, 4, 0])).first()
    assert r.final_effect == 0 and not r.large_drift_mid_to_final


def test_sample_size(spark):
    df = spark.createDataFrame([(0.12,)], "rate double")
    r = ex.sample_size_plan(df, "rate", [0.012]).first()
    assert (r.required_n_per_arm, r.total_required_n) == (11999, 23998)


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p_value double")
    rows = ex.p_value_histogram(df).orderBy("bin").collect()
    assert len(rows) == 20 and sum(r.n for r in rows) == 3 and rows[19].n == 1 and rows[10].n == 1


def test_percentiles_and_ranks_match_windows(spark):
    rng = np.random.default_rng(3)
    data = [(int(i % 3 > 0), float(v)) for i, v in enumerate(np.round(rng.normal(size=501), 1))]
    df = spark.createDataFrame(data, "g int, v double")
    got = {r.g: (r.a, r.b) for r in ranking.exact_percentiles(df, "v", {"a": 0.5, "b": 0.9}, ["g"]).collect()}
    for g in (0, 1):
        v = [x for k, x in data if k == g]
        assert got[g] == pytest.approx((np.percentile(v, 50), np.percentile(v, 90)))
    ranked = ranking.rank_descending(df, "v", ["g"], "r")
    from pyspark.sql import Window

    wrong = ranked.withColumn("w", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc()))).where("r != w")
    assert wrong.count() == 0


def test_mann_whitney(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 3.0, 4.0]
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "v double, f boolean")
    r = stats.mann_whitney(df, "v", F.col("f")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u == u and r.auc == pytest.approx(u / 20)


def plain_draws(n, b, flag, seed):
    """The middle two order statistics of n uniform numbers for one replicate and group, by the documented rule."""
    import hashlib
    import math

    def uniform(*keys):
        digest = hashlib.md5("|".join(map(str, (seed, b, str(flag).lower(), *keys))).encode()).hexdigest()
        return int(digest[:8], 16) / 2**32 + 0.5 / 2**32

    def gamma(shape, side):
        d = shape - 1 / 3
        for t in range(1, stats.GAMMA_TRIES + 1):
            x = math.sqrt(-2 * math.log(uniform(side, t, 1))) * math.cos(2 * math.pi * uniform(side, t, 2))
            w = 1 + x / math.sqrt(9 * d)
            if w > 0 and math.log(uniform(side, t, 3)) < 0.5 * x * x + d - d * w**3 + d * math.log(w**3):
                return d * w**3

    lower = (n - 1) // 2 + 1
    g, h = gamma(lower, 1), gamma(n - lower + 1, 2)
    low = g / (g + h)
    return low, low if n % 2 else low + (1 - low) * (1 - math.exp(math.log(uniform(3)) / (n - lower)))


@pytest.mark.parametrize("n", [150, 7, 2])
def test_bootstrap_medians_match_plain_computation(spark, n):
    rows = [(float((i * 37) % 101), i % 2 == 0) for i in range(n)] + [(None, True), (3.0, None)]
    df = spark.createDataFrame(rows, "v double, f boolean")
    got = {r.b: r["diff"] for r in stats.replicate_median_differences(df, "v", "f", 20, 5).collect()}
    assert set(got) == set(range(1, 21))
    for b in got:
        sides = {}
        for flag in (True, False):
            own = sorted(v for v, f in rows if f is flag and v is not None)
            sides[flag] = np.mean([own[min(len(own) - 1, int(u * len(own)))] for u in plain_draws(len(own), b, flag, 5)])
        assert got[b] == pytest.approx(sides[True] - sides[False])


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_drawn_places_are_those_of_resampling(n):
    places = np.array([[min(n - 1, int(u * n)) for u in plain_draws(n, b, True, 9)] for b in range(3000)])
    rng = np.random.default_rng(3)
    again = np.sort(rng.integers(0, n, (3000, n)), 1)[:, [(n - 1) // 2, n // 2]]
    for own, other in zip(places.T, again.T):
        grid = np.arange(n)
        gap = np.abs(np.searchsorted(np.sort(own), grid, "right") - np.searchsorted(np.sort(other), grid, "right")).max()
        assert gap / 3000 < 1.95 * np.sqrt(2 / 3000)  # Kolmogorov and Smirnov's bound at a level of 0.001
    assert abs(np.mean(places[:, 1] > places[:, 0]) - np.mean(again[:, 1] > again[:, 0])) < 0.05


def test_hashed_sample_is_exact(spark):
    df = spark.range(1000).selectExpr("id", "id % 4 AS g")
    sizes = {r.g: r["count"] for r in ranking.hashed_sample(df, "id", 0.25, ["g"]).groupBy("g").count().collect()}
    assert sizes == {0: 62, 1: 62, 2: 62, 3: 62}
