"""Churn and star models, attributions, clustering and keyphrases."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tillsight.operators import attribution, clv, density, keyphrases, metrics, models, quality, reviews, topics
from tillsight.plans import canonical as cn
from tillsight.plans import check_sql as cs
from tillsight.plans.registry import query
from tillsight.plans.retail import CHURN_SQL, churn_table
from tillsight.plans.value import fitted_values
from tillsight.sources.staging import discard, materialize

CHURN_BACKGROUND = 100
CLV_BACKGROUND = 100
CLV_EXPLAINED = 200
CLV_FEATURES = ["frequency", "recency", "T", "monetary_value"]


def churn_split(spark, sf_dir):
    features = materialize(churn_table(spark, sf_dir))
    train, test = models.stratified_split(features, "customer_id", "churned")
    return features, materialize(models.churn_matrix(train)), materialize(test)


@query(
    "m1_stratified_split",
    cs.using("tx_c")
    + f""", c AS ({CHURN_SQL}) SELECT customer_id, churned, CASE WHEN r <= round_even(n * 0.2e0, 0) THEN 'test' ELSE 'train' END AS part
FROM (SELECT customer_id, churned, COUNT(*) OVER (PARTITION BY churned) AS n,
  row_number() OVER (PARTITION BY churned ORDER BY md5('42|' || customer_id), customer_id) AS r FROM c)""",
)
def _(spark, sf_dir):
    features = materialize(churn_table(spark, sf_dir).select("customer_id", "churned"))
    train, test = models.stratified_split(features, "customer_id", "churned")
    return quality.union_all(train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))


@query("m2_m3_churn_models")
def _(spark, sf_dir):
    _, train, test = churn_split(spark, sf_dir)
    return quality.union_all(
        models.evaluate_churn("logistic", models.fit_churn_logistic(train), test),
        models.evaluate_churn("boosted", models.fit_churn_boosted(train), test),
    )


@query("m4_churn_risk")
def _(spark, sf_dir):
    features = materialize(churn_table(spark, sf_dir))
    model = models.fit_churn_boosted(models.churn_matrix(features))
    return models.churn_risk(model, features)


def churn_attribution(spark, sf_dir):
    _, train, test = churn_split(spark, sf_dir)
    model = models.fit_churn_boosted(train)
    background = attribution.background_rows(train, "customer_id", models.CHURN_FEATURES, CHURN_BACKGROUND)
    trees = attribution.boosted_trees(model)
    values = attribution.tree_shapley_values(
        models.churn_matrix(test), "customer_id", models.CHURN_FEATURES, background, trees, scale=2.0
    )
    return values, test


#: Small trees over the churn features whose attributions SQL can check by expanding all coalitions.
FIXED_TREES = [
    (1, 120.0, (2, 3.5, 0.25, -0.75), (5, 0.5, 1.5, (1, 300.0, -0.5, 2.0))),
    (0, 200.0, (3, 150000.0, 0.5, (4, 40000.0, -1.25, 0.125)), (2, 9.5, (3, 400000.0, 1.0, -0.25), -2.0)),
]


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}e0"
    feature, threshold, low, high = tree
    return f"CASE WHEN f{feature} <= {threshold}e0 THEN {_tree_sql(low)} ELSE {_tree_sql(high)} END"


def _fixed_trees_sql() -> str:
    names = models.CHURN_FEATURES
    n = len(names)
    take = ", ".join(f"CASE WHEN s & {1 << i} > 0 THEN x.f{i} ELSE z.f{i} END AS f{i}" for i in range(n))
    weight = " ".join(
        f"WHEN {size} THEN {math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)!r}" for size in range(n)
    )
    phi = ", ".join(
        f"ROUND(SUM(CASE WHEN s & {1 << i} > 0 THEN v * CASE bit_count(s) - 1 {weight} END "
        f"ELSE -v * CASE bit_count(s) {weight} END END), 9) AS phi_{c}"
        for i, c in enumerate(names)
    )
    return cs.using("tx_c") + f""", c AS ({CHURN_SQL}),
x AS (SELECT customer_id, {", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(names))} FROM c),
z AS (SELECT * FROM x ORDER BY md5('background|' || customer_id), customer_id LIMIT {CHURN_BACKGROUND}),
mixed AS (SELECT x.customer_id, s, {take} FROM x, z, (SELECT CAST(i AS INTEGER) AS s FROM range({1 << n}) r(i))),
scored AS (SELECT customer_id, s, AVG({" + ".join(_tree_sql(t) for t in FIXED_TREES)}) AS v FROM mixed GROUP BY customer_id, s)
SELECT customer_id, {phi}, ROUND(SUM(CASE WHEN s = 0 THEN v END), 9) AS base_value,
  ROUND(SUM(CASE WHEN s = {(1 << n) - 1} THEN v END), 9) AS output FROM scored GROUP BY customer_id"""


@query("m10_fixed_tree_attribution", _fixed_trees_sql())
def _(spark, sf_dir):
    rows = materialize(models.churn_matrix(churn_table(spark, sf_dir)))
    background = attribution.background_rows(rows, "customer_id", models.CHURN_FEATURES, CHURN_BACKGROUND)
    values = attribution.tree_shapley_values(rows, "customer_id", models.CHURN_FEATURES, background, FIXED_TREES)
    return values.select("customer_id", *[F.round(c, 9).alias(c) for c in values.columns[1:]])


@query("m10_churn_attribution")
def _(spark, sf_dir):
    return churn_attribution(spark, sf_dir)[0]


@query("m10_churn_importance")
def _(spark, sf_dir):
    values, _ = churn_attribution(spark, sf_dir)
    return attribution.global_importance(values, models.CHURN_FEATURES)


@query("m10_churn_examples")
def _(spark, sf_dir):
    values, test = churn_attribution(spark, sf_dir)
    return attribution.example_per_class(values, test, "customer_id", "churned")


@query("m11_clv_importance")
def _(spark, sf_dir):
    _, repeat, purchases, spend = fitted_values(spark, sf_dir)
    x, t_x, age, m = (F.col(c) for c in CLV_FEATURES)
    score = attribution.column_score(clv.lifetime_value(purchases, spend, x, t_x, age, m))
    background = attribution.background_rows(repeat, "customer_id", CLV_FEATURES, CLV_BACKGROUND)
    explained = attribution.sample_to_explain(repeat, "customer_id", CLV_EXPLAINED)
    values = attribution.shapley_values(explained, "customer_id", CLV_FEATURES, background, score)
    return attribution.global_importance(values, CLV_FEATURES)


def star_setup(spark, sf_dir, keep_texts=False):
    """Reviews, their two parts, as words, and the features of the first part. Texts are split once.

    The reviews' texts are staged for callers that keep them; else `rows` is read from the source.
    """
    rows = cn.reviews_text(spark, sf_dir).select("review_id", "full_text", "stars")
    if keep_texts:
        rows = materialize(rows)
    words = materialize(models.with_words(rows, stop_words=cn.STOP_WORDS).drop("full_text"))
    train, test = models.stratified_split(words, "review_id", "stars")
    train, test = materialize(train), materialize(test)
    discard(words)
    tfidf = models.fit_tfidf(train, stop_words=cn.STOP_WORDS)
    return rows, train, test, tfidf


@query(
    "n6_tfidf_terms",
    cs.using("rv_text")
    + rf""", split AS (SELECT review_id, full_text, row_number() OVER (PARTITION BY stars
    ORDER BY md5('42|' || review_id), review_id) > round_even(COUNT(*) OVER (PARTITION BY stars) * 0.2e0, 0) AS train FROM rv_text),
words AS (SELECT review_id, list_filter(string_split_regex(lower(full_text), '[^\p{{L}}\p{{N}}_]+'),
    lambda w: length(w) >= 2 AND w NOT IN ({cs.quoted(cn.STOP_WORDS)})) AS w FROM split WHERE train),
terms AS (SELECT review_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words),
counted AS (SELECT term, COUNT(*) AS n, COUNT(DISTINCT review_id) AS n_rows FROM terms GROUP BY term
    ORDER BY n DESC, term LIMIT 3000)
SELECT term, ROUND(ln(((SELECT COUNT(*) FROM words) + 1e0) / (n_rows + 1)) + 1, 9) AS idf FROM counted""",
)
def _(spark, sf_dir):
    _, _, _, tfidf = star_setup(spark, sf_dir)
    vocabulary, scale = tfidf.stages[4].vocabulary, tfidf.stages[5].getScalingVec().toArray()
    rows = [(t, float(w)) for t, w in zip(vocabulary, scale)]
    return spark.createDataFrame(rows, "term string, idf double").withColumn("idf", F.round("idf", 9))


def fitted_star_models(spark, sf_dir):
    """Both star models, reading features, and the features of the held-out rows."""
    _, train, test, tfidf = star_setup(spark, sf_dir)
    features = models.staged_features(tfidf, train)
    fitted = {
        "linear": models.fit_star_linear(tfidf, train, features=features),
        "boosted": models.fit_star_boosted(tfidf, train, features=features),
    }
    return {k: models.on_features(tfidf, m) for k, m in fitted.items()}, models.staged_features(tfidf, test)


@query("n7_star_models")
def _(spark, sf_dir):
    fitted, test = fitted_star_models(spark, sf_dir)
    return quality.union_all(*[models.evaluate_stars(k, m, test) for k, m in fitted.items()])


def chosen_star_predictions(spark, sf_dir):
    """Held-out predictions of the star model that does better there."""
    fitted, test = fitted_star_models(spark, sf_dir)
    scored = {k: materialize(models.predicted_stars(m, test, ["stars"])) for k, m in fitted.items()}
    scores = [metrics.overall_scores(s, "stars", "predicted_stars").withColumn("model", F.lit(k)) for k, s in scored.items()]
    return scored[models.better_model(quality.union_all(*scores))]


@query("n7_star_confusion")
def _(spark, sf_dir):
    return metrics.confusion_matrix(chosen_star_predictions(spark, sf_dir), "stars", "predicted_stars", [1, 2, 3, 4, 5])


@query("n7_star_report")
def _(spark, sf_dir):
    scored = chosen_star_predictions(spark, sf_dir)
    report = metrics.class_report(scored, "stars", "predicted_stars")
    wrong = metrics.off_by_one(scored, "stars", "predicted_stars")
    return report.withColumns({c: wrong.select(c).scalar() for c in ("wrong", "off_by_one_share")})


@query("n2_model_review_stars")
def _(spark, sf_dir):
    rows, train, _, tfidf = star_setup(spark, sf_dir, keep_texts=True)
    model = models.fit_star_linear(tfidf, train)
    texts = rows.select("review_id", "full_text")
    return reviews.score_distinct(texts, "full_text", models.star_scorer(model)).select("review_id", "predicted_stars")


@query("m12_star_attribution")
def _(spark, sf_dir):
    _, train, test, tfidf = star_setup(spark, sf_dir)
    features = models.staged_features(tfidf, train)
    model = models.fit_star_linear(tfidf, train, features=features)
    linear = model.stages[-1]
    weights = linear.coefficientMatrix.toArray().tolist()[1:]
    values = attribution.linear_attribution(
        models.staged_features(tfidf, test).select("features"),
        features.select("features"),
        weights,
        [1, 2, 3, 4, 5],
        tfidf.stages[4].vocabulary,
    )
    return attribution.top_terms(values)


@query("n8_embedding_clusters")
def _(spark, sf_dir):
    vectors = cn.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")
    return topics.cluster(vectors, "review_id", "embedding", k=10)


DENSITY_SIMILARITY, DENSITY_POINTS = 0.3, 6


@query(
    "n8_density_topics",
    f"""WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS v FROM u),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, ROUND(list_dot_product(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE ROUND(list_dot_product(a.v, b.v), 9) >= {DENSITY_SIMILARITY}e0),
dense AS (SELECT a FROM p GROUP BY a HAVING COUNT(*) + 1 >= {DENSITY_POINTS}),
e AS (SELECT a, b FROM p SEMI JOIN dense USING (a) WHERE b IN (SELECT a FROM dense)),
reach AS (SELECT a, a AS b FROM dense UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
core AS (SELECT a, MIN(b) AS label FROM reach GROUP BY a),
border AS (SELECT p.a, arg_min(label, (-s, b)) AS label FROM p JOIN core ON p.b = core.a
  WHERE p.a NOT IN (SELECT a FROM dense) GROUP BY p.a),
placed AS (SELECT * FROM core UNION ALL SELECT * FROM border),
named AS (SELECT label, row_number() OVER (ORDER BY COUNT(*) DESC, MIN(a)) - 1 AS topic FROM placed GROUP BY label)
SELECT vec_id AS review_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic
FROM v LEFT JOIN placed ON vec_id = a LEFT JOIN named USING (label)""",
)
def _(spark, sf_dir):
    vectors = cn.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")
    return density.density_topics(vectors, "review_id", "embedding", DENSITY_SIMILARITY, DENSITY_POINTS)


@query("n11_keyphrases")
def _(spark, sf_dir):
    rows = cn.reviews_text(spark, sf_dir).select("review_id", "full_text")
    return keyphrases.keyphrases(rows, "review_id", "full_text")
