import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.functions import numerics as nx
from tillsight.operators import attribution, clv, models
from tillsight.plans import modelling


def test_numerics(spark):
    xs = [-3.0, -0.5, 0.0, 1.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in zip(xs, [r[0] for r in df.select(nx.normal_cdf(F.col("x"))).collect()]):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-14)
    pos = spark.createDataFrame([(0.01,), (3.7,), (250.0,)], "x double")
    for r in pos.select("x", nx.log_gamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-10)
    one = spark.range(1).select(nx.hyp2f1(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(0.5), 80).alias("v")).first().v
    assert one == pytest.approx(-math.log(0.5) / 0.5)


def test_summary_and_holdout(spark):
    rows = [("a", "2011-01-01", 10.0), ("a", "2011-01-01", 5.0), ("a", "2011-01-11", 20.0), ("a", "2011-02-10", 40.0), ("b", "2011-01-05", 7.0)]
    df = spark.createDataFrame(rows, "customer_id string, d string, invoice_value double").selectExpr("customer_id", "to_date(d) invoice_date", "invoice_value")
    end = F.to_date(F.lit("2011-02-20"))
    got = {r.customer_id: r for r in clv.purchase_summary(df, end).collect()}
    assert (got["a"].frequency, got["a"].recency, got["a"]["T"], got["a"].monetary_value) == (2, 40, 50, 30.0)
    assert (got["b"].frequency, got["b"].recency, got["b"]["T"], got["b"].monetary_value) == (0, 0, 46, 0.0)
    hold = {r.customer_id: r for r in clv.calibration_holdout(df, "2011-01-31", end).collect()}
    assert (hold["a"].frequency_cal, hold["a"].frequency_holdout, hold["a"].monetary_value_holdout) == (1, 1, 40.0)
    assert (hold["b"].frequency_holdout, hold["b"].duration_holdout) == (0, 20)


def simulated_buyers(n=4000, r=1.2, alpha=20.0, a=1.0, b=3.0, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for lam, p, age in zip(rng.gamma(r, 1 / alpha, n), rng.beta(a, b, n), rng.integers(100, 400, n)):
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam)
            if t > age:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        out.append((x, float(round(last)), float(age)))
    return out


def test_bgnbd_recovers_parameters(spark):
    df = spark.createDataFrame(simulated_buyers(), "frequency int, recency double, T double")
    fitted = clv.fit_bgnbd(df, penalty=0.0)
    assert fitted["r"] / fitted["alpha"] == pytest.approx(1.2 / 20.0, rel=0.15)
    assert fitted["a"] / (fitted["a"] + fitted["b"]) == pytest.approx(0.25, rel=0.2)


def test_pareto_likelihood_is_a_density(spark):
    """P(x = 0) from the fit formula equals a fine trapezoid sum over the leaving time."""
    r, alpha, s, beta, age = 0.8, 12.0, 0.7, 30.0, 60.0
    ll = clv._pareto_loglik(*[np.array([[v]]) for v in (r, alpha, s, beta)], np.array([[0.0]]), np.array([[0.0]]), np.array([[age]]))
    u = np.linspace(0, age, 200001)
    density = s * beta**s / (beta + u) ** (s + 1) * (alpha / (alpha + u)) ** r
    area = np.sum((density[1:] + density[:-1]) / 2) * (u[1] - u[0])
    want = (alpha / (alpha + age)) ** r * (beta / (beta + age)) ** s + area
    assert float(np.exp(ll[0, 0])) == pytest.approx(want, rel=1e-6)


def test_gamma_gamma_recovers_mean(spark):
    rng = np.random.default_rng(11)
    nu = rng.gamma(4.0, 1 / 60.0, 3000)
    x = rng.integers(1, 12, 3000)
    m = rng.gamma(3.0 * x, 1.0 / (nu * x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, m)], "frequency int, monetary_value double")
    p = clv.fit_gamma_gamma(df, penalty=0.0)
    assert p["p"] * p["v"] / (p["q"] - 1) == pytest.approx(3.0 * 60.0 / 3.0, rel=0.1)


def test_shapley_of_a_linear_score(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 5.0), (2, -1.0, 0.0, 4.0)], "id int, a double, b double, c double")
    background = [(0.0, 1.0, 2.0), (2.0, 3.0, 0.0)]
    score = attribution.column_score(2.0 * F.col("a") - F.col("b") + 0.5 * F.col("c"))
    for r in attribution.shapley_values(df, "id", ["a", "b", "c"], background, score).collect():
        x = {1: (2, 3, 5), 2: (-1, 0, 4)}[r.id]
        assert (r.phi_a, r.phi_b, r.phi_c) == pytest.approx((2 * (x[0] - 1), -(x[1] - 2), 0.5 * (x[2] - 1)))
        assert r.base_value + r.phi_a + r.phi_b + r.phi_c == pytest.approx(r.output)


def test_shapley_adds_up_for_a_product(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    r = attribution.shapley_values(df, "id", ["a", "b"], [(0.0, 0.0)], attribution.column_score(F.col("a") * F.col("b"))).first()
    assert (r.phi_a, r.phi_b, r.base_value, r.output) == (3.0, 3.0, 0.0, 6.0)


def test_tree_attribution_equals_the_expansion_of_all_coalitions(spark):
    sf_dir = "/root/testdata/sf0.001"
    _, train, test = modelling.churn_split(spark, sf_dir)
    model = models.fit_churn_boosted(train, rounds=8)
    names = models.CHURN_FEATURES
    background = attribution.background_rows(train, "customer_id", names, 20)
    rows = models.churn_matrix(test)
    want = attribution.shapley_values(rows, "customer_id", names, background, attribution.model_margin(model))
    found = attribution.tree_shapley_values(rows, "customer_id", names, background, attribution.boosted_trees(model), 2.0)
    assert found.columns == want.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and "Join" not in plan
    want, found = ({r.customer_id: r for r in df.collect()} for df in (want, found))
    assert want.keys() == found.keys() and len(want) > 10
    for k, row in want.items():
        for c in row.asDict():
            assert found[k][c] == pytest.approx(row[c], abs=1e-9), (k, c)


def test_trees_with_repeated_features_and_dead_leaves(spark):
    tree = (0, 1.0, (0, 2.0, 3.0, 99.0), (1, 0.0, (0, 5.0, -1.0, 4.0), (0, 1.0, 99.0, 7.0)))
    assert sorted(v for v, _ in attribution.leaves_of(tree)) == [-1.0, 3.0, 4.0, 7.0]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate([(0, 0), (1, 1), (3, -1), (9, 2)])]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    value = lambda a, b: F.when(a <= 1, 3.0).when(b > 0, 7.0).when(a <= 5, -1.0).otherwise(4.0)
    background = [(0.5, 1.0), (6.0, -2.0), (2.0, 3.0)]
    want = attribution.shapley_values(df, "id", ["a", "b"], background, attribution.column_score(value(F.col("a"), F.col("b"))))
    got = attribution.tree_shapley_values(df, "id", ["a", "b"], background, [tree])
    for x, y in zip(sorted(want.collect()), sorted(got.collect())):
        assert tuple(y) == pytest.approx(tuple(x))
    with pytest.raises(ValueError):
        attribution.parse_trees("Model\n  Tree 0 (weight 1.0):\n    If (feature 1 in {0.0})\n     Predict: 1.0\n")


def test_star_model_and_linear_attribution(spark, tmp_path):
    from tillsight.sources import writers

    rows = [(i, f"awful broken item number{i % 3}", 1) for i in range(20)] + [(100 + i, f"lovely perfect gift number{i % 3}", 5) for i in range(20)]
    df = spark.createDataFrame(rows, "review_id int, full_text string, stars int")
    train, test = models.stratified_split(df, "review_id", "stars")
    assert sorted((r.stars, r["count"]) for r in test.groupBy("stars").count().collect()) == [(1, 4), (5, 4)]
    tfidf = models.fit_tfidf(train, terms=50)
    model = models.fit_star_linear(tfidf, train)
    assert models.evaluate_stars("linear", model, test).first().accuracy == 1.0
    path = f"file:{tmp_path}/model"
    writers.save_model(model, path)
    again = models.predicted_stars(writers.load_model(path), test, ["review_id"])
    assert again.count() == 8
    vectors = tfidf.transform(test).select("features")
    weights = model.stages[-1].coefficientMatrix.toArray()
    learned = tfidf.transform(train).select("features")
    got = attribution.linear_attribution(vectors, learned, weights.tolist()[1:], [1, 2, 3, 4, 5], tfidf.stages[4].vocabulary)
    x, seen = (np.array([r.features.toArray() for r in v.collect()]) for v in (vectors, learned))
    want = np.abs(weights[1] * (x - seen.mean(axis=0))).mean(axis=0)
    terms = tfidf.stages[4].vocabulary
    for r in got.where("class = '1'").collect():
        assert r.mean_abs == pytest.approx(want[terms.index(r.feature)], abs=1e-12)
