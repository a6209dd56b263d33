"""Topics over given embeddings: clustering, labels and validation."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import text as tx
from tillsight.operators import ranking
from tillsight.sources.staging import materialize

OUTLIER = -1


def small_topics_to_outliers(topics: DataFrame, min_size: int) -> DataFrame:
    """Topics with fewer than `min_size` rows become the outlier topic."""
    sizes = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    kept = F.when(F.col("_n") >= min_size, F.col("topic")).otherwise(OUTLIER)
    return topics.join(sizes, "topic").withColumn("topic", kept).drop("_n").select(*topics.columns)


def cluster(
    df: DataFrame, key: str, embedding: str, k: int, min_size: int = 30, max_distance_share: float = 0.95, seed: int = 42
) -> DataFrame:
    """K-means topics; rows far from every centre, and small topics, are outliers.

    The distance cut is the exact percentile of all distances to the own centre.
    Centres are the only thing that travels to the executors.
    """
    vectors = df.select(key, array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic").fit(vectors)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    placed = model.transform(vectors).withColumn("_x", vector_to_array("features"))
    gap = F.aggregate(
        F.zip_with("_x", F.element_at(centres, F.col("topic") + 1), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda acc, d: acc + d,
    )
    distanced = materialize(placed.select(key, "topic", gap.alias("_d")))
    limit = ranking.exact_percentiles(distanced, "_d", {"limit": max_distance_share}).scalar()
    near = distanced.withColumn("_limit", limit).select(
        key, F.when(F.col("_d") <= F.col("_limit"), F.col("topic")).otherwise(OUTLIER).cast("int").alias("topic")
    )
    return small_topics_to_outliers(near, min_size)


def topic_words(df: DataFrame, topic: str, text: str, top: int = 4) -> DataFrame:
    """Highest class-TF-IDF words: tf * ln(1 + mean words per topic / word total)."""
    words = tx.exploded(df, tx.words(F.col(text)), "word", topic)
    tf = materialize(words.groupBy(topic, "word").agg(F.count(F.lit(1)).alias("tf")))
    total = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    mean_words = tf.agg(F.sum("tf") / F.countDistinct(topic)).scalar()
    scored = tf.join(total, "word").withColumn("_a", mean_words)
    scored = scored.withColumn("score", F.round(F.col("tf") * F.log(1.0 + F.col("_a") / F.col("f")), 6)).drop("_a")
    best = Window.partitionBy(topic).orderBy(F.col("score").desc(), "word")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)


def topic_summary(assigned: DataFrame, text: str, top: int = 4) -> DataFrame:
    """Topic, Count and Name (`topic_word1_word2_...`), as a label table."""
    ranked = topic_words(assigned, "topic", text, top)
    names = ranked.groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"]), "_").alias("_w")
    )
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(names, "topic", "left").select(
        "topic", "count", F.concat_ws("_", F.col("topic").cast("string"), "_w").alias("name")
    )


def category_concentration(assigned: DataFrame, top: int = 16) -> DataFrame:
    """Dominant category of the largest topics; rows without one do not count in its share."""
    counts = assigned.groupBy("topic", "category").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("category").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("less"), F.col("category")))).alias("best")
    folded = counts.groupBy("topic").agg(
        F.sum("n").alias("count"), F.sum(F.when(known, F.col("n"))).alias("_known"), best,
        F.count_if(known).alias("n_unique_categories"),
    )
    return (
        folded.select(
            "topic",
            "count",
            F.col("best.category").alias("dominant_category"),
            F.round(-F.col("best.less") / F.col("_known"), 3).alias("dominant_pct"),
            "n_unique_categories",
        )
        .orderBy(F.col("count").desc(), "topic")
        .limit(top)
    )
