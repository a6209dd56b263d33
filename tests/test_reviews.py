import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.functions import text as tx
from tillsight.operators import documents, keyphrases, metrics, reviews, topics


def test_full_text_and_sentences(spark):
    df = spark.createDataFrame([("Hi", " ok! Fine?\nYes.  "), (None, None)], "t string, r string")
    full = df.select(tx.full_text(F.col("t"), F.col("r")).alias("x"))
    rows = full.select("x", tx.sentences(F.col("x")).alias("s")).collect()
    assert rows[0].s == ["Hi.", "ok!", "Fine?", "Yes."]
    assert rows[1].x == "." and rows[1].s == ["."]


def test_phrase_split_is_literal(spark):
    df = spark.createDataFrame([("good value | fast | a|b",)], "k string")
    assert df.select(tx.split_phrases(F.col("k")).alias("s")).first().s == ["good value", "fast", "a|b"]


def test_buckets(spark):
    df = spark.createDataFrame([(-0.05,), (-0.049,), (0.05,)], "c double")
    assert [r[0] for r in df.select(reviews.score_bucket(F.col("c"))).collect()] == ["negative", "neutral", "positive"]
    assert spark.range(1, 6).select(reviews.star_bucket(F.col("id")).alias("b")).collect()[2].b == "neutral"
    label = spark.createDataFrame([("4 stars",)], "l string")
    assert label.select(reviews.stars_from_label(F.col("l")).alias("s")).first().s == 4


def test_lexicon_sentiment(spark):
    df = spark.createDataFrame([(1, "Good, not a good day"), (2, "nothing here")], "id int, t string")
    lexicon = reviews.lexicon_table(spark, {"good": 2.0})
    got = {r.id: r.compound for r in reviews.lexicon_sentiment(df, ["id"], "t", lexicon, ["not"]).collect()}
    s = 2.0 - 0.74 * 2.0
    assert got[1] == pytest.approx(s / math.sqrt(s * s + 15)) and got[2] == 0.0


def test_aspects(spark):
    text = "Fast DELIVERY and great price. Staff were rude! Nothing."
    df = spark.createDataFrame([(1, 5, text)], "review_id int, stars int, full_text string")
    rows = {(r.aspect, r.sentence) for r in reviews.aspect_mentions(df, reviews.RETAIL_ASPECTS).collect()}
    assert rows == {
        ("delivery", "Fast DELIVERY and great price."),
        ("price_value", "Fast DELIVERY and great price."),
        ("customer_service", "Staff were rude!"),
    }


def parts(spark):
    rows = spark.createDataFrame([(1, 7, "t", "r", 3), (2, 7, "t", "r", 4)], "review_id int, company_id int, title string, review string, stars int")
    sentiment = spark.createDataFrame([(1, 0.5, "positive", 4, "positive")], "review_id int, lexicon_compound double, lexicon_bucket string, model_predicted_stars int, model_bucket string")
    aspects = spark.createDataFrame([(1, "a", f"s{i:02d}", 3) for i in range(20)], "review_id int, aspect string, sentence string, predicted_stars int")
    topic = spark.createDataFrame([(1, -1)], "review_id int, topic int")
    labels = spark.createDataFrame([(0, "0_x")], "topic int, name string")
    keywords = spark.createDataFrame([(1, " | ".join("abcde"))], "review_id int, keywords string")
    return rows, sentiment, aspects, topic, labels, keywords


def test_documents_defaults_and_fan_out(spark):
    rows, sentiment, aspects, topic, labels, keywords = parts(spark)
    docs = documents.build_documents(rows, sentiment, aspects, topic, labels, keywords)
    by_id = {r._id: r for r in docs.collect()}
    assert len(by_id[1].aspects) == 20 and by_id[1].keywords == list("abcde")
    assert by_id[1].topic.topic_label == "unknown"
    assert by_id[2].sentiment is None and by_id[2].aspects == [] and by_id[2].keywords == []
    assert by_id[2].topic.topic_id == -1
    counts = documents.child_counts(rows, aspects, keywords)
    assert documents.fan_out(counts).where("review_id = 1").first().joined_rows == 100
    bridge = documents.sentiment_bridge(sentiment, topic, labels)
    assert bridge.first().topic_label == documents.OUTLIER_LABEL
    profile = documents.review_profile(1, rows, bridge, aspects, documents.keyword_rows(keywords))
    assert profile.count() == 100
    assert documents.aspects_bridge(docs).count() == 20 and documents.keywords_bridge(docs).count() == 5
    assert documents.coverage(counts).first().share_with_aspects == 0.5
    firsts = documents.first_with_and_without(counts).collect()
    assert sorted((r.with_aspects, r.review_id) for r in firsts) == [(False, 2), (True, 1)]
    assert '"aspects":[]' in documents.as_json(docs).where("_id = 2").first().document


def test_metrics(spark):
    rows = [(1, 1), (1, 2), (2, 2), (2, 2), (3, 1)]
    df = spark.createDataFrame(rows, "a int, p int")
    report = {r.label: r for r in metrics.class_report(df, "a", "p").collect()}
    assert report[2].precision == pytest.approx(2 / 3) and report[2].recall == 1.0
    assert report[3].f1 == 0.0 and report[3].support == 1
    overall = metrics.overall_scores(df, "a", "p").first()
    assert overall.accuracy == pytest.approx(0.6) and overall.macro_f1 == pytest.approx((0.5 + 0.8 + 0) / 3)
    assert metrics.off_by_one(df, "a", "p").first().off_by_one_share == 0.5


def test_topic_labels(spark):
    df = spark.createDataFrame([(0, "red red shoe"), (0, "red hat"), (1, "blue hat")], "topic int, text string")
    named = {r.topic: r.name for r in topics.topic_summary(df, "text", top=1).collect()}
    assert named == {0: "0_red", 1: "1_blue"}


def plain_mmr(words, idf, top, diversity):
    """Dense vectors over the whole vocabulary, every pair compared."""
    vocabulary = sorted(set(words))
    candidates = {(w,) for w in words} | set(zip(words, words[1:]))
    vectors = {c: np.array([c.count(v) * idf[v] for v in vocabulary], float) for c in candidates}
    doc = np.array([words.count(v) * idf[v] for v in vocabulary], float)

    def cos(x, y):
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))

    chosen = []
    while candidates and len(chosen) < top:
        def score(c):
            near = max((cos(vectors[c], vectors[k]) for k in chosen), default=None)
            r = round(cos(vectors[c], doc), 9)
            return r if near is None else round((1 - diversity) * r - diversity * near, 9)

        best = min(candidates, key=lambda c: (-score(c), " ".join(c)))
        chosen.append(best)
        candidates.remove(best)
    return [" ".join(c) for c in chosen]


def test_keyphrases_match_plain_search(spark):
    texts = ["late parcel late parcel broken box refund slow refund", "great shop great price", "box of tea and box of cups", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.keywords for r in keyphrases.keyphrases(df, "id", "t").collect()}
    skip = set(keyphrases.stop_words())
    tokens = [[w for w in t.split() if w not in skip and len(w) > 1] for t in texts]
    idf = {w: math.log(5 / (1 + sum(w in t for t in tokens))) + 1 for t in tokens for w in t}
    for i, t in enumerate(tokens):
        assert got[i] == " | ".join(plain_mmr(t, idf, 5, 0.5))
