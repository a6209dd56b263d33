"""Nested review documents and their relational bridge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions import text as tx

# A fixed value of the stored tables.
OUTLIER_LABEL = "no_coherent_topic (outlier)"


def build_documents(
    reviews: DataFrame, sentiment: DataFrame, aspects: DataFrame, topics: DataFrame, labels: DataFrame, keywords: DataFrame
) -> DataFrame:
    """One nested record per review; whatever is missing gets its default.

    All parts stand below each other, each in a column of its own, and one
    aggregation by review gathers them: a review's parts meet in one shuffle.
    """
    parts = {
        "fact": reviews.select("review_id", F.struct("company_id", "title", "review", "stars").alias("fact")),
        "sentiment": sentiment.select("review_id", F.struct(*_sentiment_fields()).alias("sentiment")),
        "aspect": aspects.select("review_id", F.struct("aspect", "sentence", "predicted_stars").alias("aspect")),
        "topic": topics.select("review_id", "topic"),
        "keywords": keywords.select("review_id", "keywords"),
    }
    stacked = None
    for part in parts.values():
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("fact", "sentiment", "topic", "keywords")]
    gathered = (
        stacked.groupBy("review_id")
        .agg(*first, F.array_sort(F.collect_list("aspect")).alias("aspects"))
        .where("fact is not null")
        .withColumn("topic", F.coalesce("topic", F.lit(-1)))
    )
    joined = gathered.join(labels.select("topic", F.col("name").alias("topic_label")), "topic", "left")
    return joined.select(
        F.col("review_id").alias("_id"),
        "fact.*",
        "sentiment",
        "aspects",
        F.struct(
            F.col("topic").alias("topic_id"), F.coalesce("topic_label", F.lit("unknown")).alias("topic_label")
        ).alias("topic"),
        F.coalesce(tx.split_phrases(F.col("keywords")), F.array().cast("array<string>")).alias("keywords"),
    )


def _sentiment_fields() -> list[str]:
    return ["lexicon_compound", "lexicon_bucket", "model_predicted_stars", "model_bucket"]


def sentiment_bridge(sentiment: DataFrame, topics: DataFrame, labels: DataFrame) -> DataFrame:
    """Fixed-shape table, one row per review; the outlier topic has its own label."""
    named = labels.select("topic", F.col("name").alias("_name"))
    label = F.when(F.col("topic") == -1, OUTLIER_LABEL).otherwise(F.col("_name"))
    return (
        sentiment.select("review_id", *_sentiment_fields())
        .join(topics.select("review_id", "topic"), "review_id", "left")
        .join(named, "topic", "left")
        .select(
            "review_id",
            F.col("lexicon_compound").cast("decimal(6,4)").alias("lexicon_compound"),
            "lexicon_bucket",
            F.col("model_predicted_stars").cast("smallint").alias("model_predicted_stars"),
            "model_bucket",
            F.col("topic").alias("topic_id"),
            label.alias("topic_label"),
        )
    )


def aspects_bridge(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("_id").alias("review_id"), F.explode("aspects").alias("a")).select("review_id", "a.*")


def keywords_bridge(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("_id").alias("review_id"), F.explode("keywords").alias("keyword"))


def keyword_rows(keyword_strings: DataFrame) -> DataFrame:
    return keyword_strings.where(F.col("keywords").isNotNull()).select(
        "review_id", F.explode(tx.split_phrases(F.col("keywords"))).alias("keyword")
    )


def review_profile(review_id: int, reviews: DataFrame, sentiment: DataFrame, aspects: DataFrame, keywords: DataFrame) -> DataFrame:
    """The relational profile of one review: its joins multiply aspects by keywords."""
    one = F.col("review_id") == review_id
    return (
        reviews.where(one)
        .select("review_id", "stars")
        .join(sentiment.where(one).select("review_id", "lexicon_bucket", "topic_label"), "review_id")
        .join(aspects.where(one).select("review_id", "aspect", F.col("sentence").alias("aspect_sentence")), "review_id", "left")
        .join(keywords.where(one).select("review_id", "keyword"), "review_id", "left")
    )


def child_counts(reviews: DataFrame, mentions: DataFrame, keywords: DataFrame) -> DataFrame:
    """review_id and the numbers of aspect mentions and keywords its document has."""
    counted = mentions.groupBy("review_id").agg(F.count(F.lit(1)).cast("int").alias("aspects"))
    phrases = keywords.select("review_id", F.size(tx.split_phrases(F.col("keywords"))).alias("keywords"))
    joined = reviews.select("review_id").join(counted, "review_id", "left").join(phrases, "review_id", "left")
    return joined.select("review_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("aspects", "keywords")])


def fan_out(counts: DataFrame) -> DataFrame:
    """Rows the relational profile of each review would have, without joining."""
    rows = F.greatest("aspects", F.lit(1)) * F.greatest("keywords", F.lit(1))
    return counts.select("review_id", "aspects", "keywords", rows.alias("joined_rows"))


def coverage(counts: DataFrame) -> DataFrame:
    n = F.col("aspects")
    some = n > 0
    return counts.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(some).alias("with_aspects"),
        F.round(F.avg(some.cast("double")), 4).alias("share_with_aspects"),
        F.min(F.when(some, n)).alias("fewest_aspects"),
        F.max(F.when(some, n)).alias("most_aspects"),
    )


def topic_of(reviews: DataFrame, topics: DataFrame, labels: DataFrame) -> DataFrame:
    """The part of the documents that a search by topic reads: _id and topic."""
    placed = reviews.select("review_id").join(topics.select("review_id", "topic"), "review_id", "left")
    named = placed.withColumn("topic", F.coalesce("topic", F.lit(-1))).join(
        labels.select("topic", F.col("name").alias("topic_label")), "topic", "left"
    )
    return named.select(
        F.col("review_id").alias("_id"),
        F.struct(F.col("topic").alias("topic_id"), F.coalesce("topic_label", F.lit("unknown")).alias("topic_label")).alias(
            "topic"
        ),
    )


def first_with_and_without(counts: DataFrame) -> DataFrame:
    """The smallest review with and the smallest without aspect mentions."""
    some = F.col("aspects") > 0
    return counts.groupBy(some.alias("with_aspects")).agg(F.min("review_id").alias("review_id"))


def find_document(documents: DataFrame, key: int) -> DataFrame:
    return documents.where(F.col("_id") == key)


def search_by_topic(documents: DataFrame, phrase: str) -> DataFrame:
    label: Column = F.col("topic.topic_label")
    return documents.where(F.lower(label).contains(phrase.lower()))


def as_json(documents: DataFrame) -> DataFrame:
    body = F.struct(*[c for c in documents.columns])
    return documents.select("_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
