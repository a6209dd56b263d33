"""What steps leave on the disk."""

import re
import time
from pathlib import Path

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tillsight.operators import boosting, cleaning, keyphrases, models, reviews
from tillsight.plans import canonical as cn
from tillsight.plans import voice
from tillsight.sources import staging

SF_DIR = "/root/testdata/sf0.001"


def shuffle_files(spark) -> set[str]:
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    names = (blocks.apply(i).name() for i in range(blocks.size()))
    return {n for n in names if re.match(r"shuffle_\d+", n)}


def left_of(spark, before: set[str]) -> set[str]:
    """Shuffle files that are new, once removal, which runs beside the query, has had its time."""
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def staged_folders(spark) -> set[Path]:
    return set(Path(staging.new_folder(spark).removeprefix("file:")).parent.glob("*"))


def test_a_staged_step_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(staging.CLEANUP_SETTING)
    sums = spark.range(1000).groupBy(F.col("id") % 7).agg(F.sum("id").alias("s"))
    staged = staging.materialize(sums)
    assert not left_of(spark, before)
    assert spark.conf.get(staging.CLEANUP_SETTING) == setting
    assert staged.agg(F.sum("s")).first()[0] == 499_500


def test_the_pipeline_keeps_the_documents_of_one_stage(spark, tmp_path, monkeypatch):
    spark.range(10).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    same = [(f"s{k}", lambda session, docs, folder: docs.where("doc_id > 0")) for k in range(4)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", same)
    before = staged_folders(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 9
    assert len(staged_folders(spark) - before) == 1
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 10


def test_keyphrases_leave_texts_where_they_are(spark, monkeypatch):
    texts = ["late parcel late box", "great shop great price", "box late price", None, "", "only late here", "shop here box"]
    keys = [1, 1, 2, 3, 4, None, 6]
    df = spark.createDataFrame(list(zip(keys, texts)), "id int, t string")
    found = keyphrases.keyphrases(df, "id", "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(str, found.collect()))
    assert len(want) == 7 and not any("None)" in r for r in want)
    for few in (0, 1, 2):  # the other words meet their weights in a join
        monkeypatch.setattr(keyphrases, "COMMON_WORDS", few)
        assert sorted(map(str, keyphrases.keyphrases(df, "id", "t").collect())) == want


def test_reviews_shuffle_their_texts_once(spark):
    plan = cn.reviews(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.split("RepartitionByExpression")[1:]]
    assert len(dealt) == 1


def test_copies_are_found_by_stand_ins(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", "x"), (2, "b", "x"), (4, "b", "x"), (None, "c", "c"), (5, None, "a")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    short = df.withColumn("a", F.sha2("a", 256))
    want, got = (cleaning.first_of_copies(df, "k", ["a", "b"], s) for s in (None, short))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sentences_are_scored_where_they_are(spark, monkeypatch):
    texts = ["the good parcel", "not the good parcel", None, "", "the good parcel", "bad, bad."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    words = reviews.lexicon_table(spark, {"good": 2.5, "bad": -3.0, "the": 0.1})
    found = reviews.score_distinct(df, "t", reviews.lexicon_star_scorer(words, ["not"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(reviews, "LEXICON_WORDS", 1)  # a lexicon that meets distinct texts in a join
    joined = reviews.score_distinct(df, "t", reviews.lexicon_star_scorer(words, ["not"]))
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert found.schema["predicted_stars"].dataType == joined.schema["predicted_stars"].dataType
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))


def test_staged_reviews_hold_their_text_once(spark):
    rows = voice.staged_reviews(spark, SF_DIR)
    stored = spark.read.parquet(*rows.inputFiles())
    assert "full_text" not in stored.columns and "full_text" in rows.columns
    want = cn.reviews_text(spark, SF_DIR).select("review_id", "full_text").collect()
    assert sorted(rows.select("review_id", "full_text").collect()) == sorted(want)


def test_a_step_of_boosting_leaves_no_shuffle_files(spark):
    rows = spark.createDataFrame([(i % 2, [i % 2 * 4 + 1]) for i in range(40)], "label int, codes array<int>")
    before = shuffle_files(spark)
    boosting.fit_trees(rows, 2, np.zeros((2, 2)), 1, 2, 4)
    assert not left_of(spark, before)


def test_a_split_leaves_rows_where_they_are(spark, monkeypatch):
    rows = [(i % 50 if i % 7 else None, i % 3, "x" * i) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, label int, t string")
    parts = models.stratified_split(df, "k", "label")
    assert all("Exchange hash" not in p._jdf.queryExecution().executedPlan().toString() for p in parts)
    monkeypatch.setattr(models, "TEST_KEYS", 0)  # more keys than are sent to all tasks
    for got, want in zip(parts, models.stratified_split(df, "k", "label")):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
