"""Canonical inputs derived from the shared test tables.

Each function maps the driver tables to one input of the engine (raw order
lines, raw reviews, experiment snapshots, ...). The expressions only use keys
and literals, so any SQL engine can produce the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillsight.functions import text as tx
from tillsight.operators import cleaning

CUTOFF = "2001-05-01"
FOREIGN = "Θάλασσα γαλάζια και ήλιος πάνω από το νησί σήμερα"
ONLY_DIGITS = "5550142"

# Parameters of the text operators for the shared prose, which is invented:
# frequent words and fragments stand in for a domain vocabulary.
ASPECTS = {
    "delivery": ["the ", "tion"],
    "customer_service": ["que", "von "],
    "product_quality": ["and ", "und "],
    "price_value": ["is ", "ing "],
    "returns_refunds": ["from", "des "],
}
LEXICON = {
    "the": 0.6,
    "of": -0.4,
    "and": 0.9,
    "to": -1.1,
    "in": 0.3,
    "la": 1.2,
    "is": -0.7,
    "that": -1.6,
    "en": 0.8,
    "it": 1.4,
    "was": -2.1,
    "with": 1.9,
    "des": -0.5,
    "und": 1.1,
    "les": -1.3,
    "der": 0.2,
    "die": -0.9,
    "que": 2.2,
    "from": -1.8,
}
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "was", "with", "for", "on", "as", "are", "be", "by"]
NEGATORS = ["for", "on", "le", "by"]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file footer once per process."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


#: Rows of order lines or events that one task sorts or groups at once.
ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int, per_task: int | None = None) -> int | None:
    """The number of tasks for so many rows, or None where adaptive execution may choose it."""
    n = -(-rows // (per_task or ROWS_PER_TASK))
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """`df`, of about `rows` rows, dealt by its keys over tasks whose number grows with the rows.

    A small table is left to adaptive execution. A larger one is not, as that
    joins compressed pieces into one for each core, whatever the rows need in memory.
    """
    n = tasks_for(df.sparkSession, rows, per_task)
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """The columns of a source, dealt by key over all tasks.

    A file with few row groups would keep all later work in as many tasks.
    """
    source = table(spark, sf_dir, name)
    return dealt(source.select(*columns), source.count(), key)


def transactions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines, dealt by invoice."""
    source = table(spark, sf_dir, "lineitem")
    rows = source.count()
    lines = source.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = spread_table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    headers = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = dealt(
        dealt(lines, rows, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")), rows, "l_orderkey"
    ).join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    repeated, reversed_later = key % 31 == 0, key % 40 == 0

    def copies_of(*numbers: int):
        return F.array(*[F.lit(n) for n in numbers])

    copies = (
        F.when(repeated & reversed_later, copies_of(0, 1, 2))
        .when(repeated, copies_of(0, 1))
        .when(reversed_later, copies_of(0, 2))
        .otherwise(copies_of(0))
    )
    returned = (F.col("l_returnflag") == "R") & (key % 20 == 7)
    mirrored = F.col("copy") == 2
    quantity = F.col("l_quantity").cast("int")
    raw = joined.withColumn("copy", F.explode(copies)).select(
        F.concat(F.when(mirrored, "C9").when(returned, "C").otherwise(""), key.cast("string")).alias("invoice"),
        F.when(part % 97 == 0, "POST")
        .when(part % 499 == 1, "TEST001")
        .otherwise(F.concat(F.lit("P"), part.cast("string")))
        .alias("stock_code"),
        F.when(part % 100 == 0, " Damaged").when(part % 53 != 0, F.col("p_name")).alias("description"),
        F.when(mirrored | returned, -quantity).otherwise(quantity).alias("quantity"),
        F.col("o_orderdate").alias("invoice_date"),
        F.when(part % 997 == 5, -1.0).when(part % 50 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("customer_id"),
        F.when(key % 7 == 0, "NATION_0").otherwise(F.col("n_name")).alias("country"),
    )
    return dealt(raw, rows, "invoice")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_transactions(transactions_raw(spark, sf_dir))


def reviews_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "doc_id", "text", "lang", "source")
    return _labelled(docs.withColumn("text", _review_text()), table(spark, sf_dir, "labels"))


def _review_text() -> Column:
    i = F.col("doc_id")
    return (
        F.when(i % 211 == 3, "...........")
        .when(i % 223 == 5, ONLY_DIGITS)
        .when(i % 227 == 7, FOREIGN)
        .otherwise(F.col("text"))
    )


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    stars = (
        F.when(F.col("quality").isNull(), 1 + i % 5)
        .when(F.col("quality") == 0, 1 + i % 2)
        .when(F.col("toxic") == 1, F.lit(3))
        .otherwise(4 + i % 2)
    )
    return docs.join(labels, "doc_id", "left").select(
        i.alias("review_id"),
        F.col("lang").alias("category"),
        F.col("source").alias("company"),
        F.concat(F.lit("profile "), "source").alias("description"),
        F.concat(F.lit("Review of "), "source").alias("title"),
        F.col("text").alias("review"),
        stars.cast("int").alias("stars"),
    )


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_keyed(spark, sf_dir).drop("review_id")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded reviews: of exact copies the first stays, junk removed.

    Copies are found by digests of the texts, taken where the table is read, so
    that texts are shuffled once.
    """
    keyed = reviews_keyed(spark, sf_dir)
    content = [c for c in keyed.columns if c != "review_id"]
    source = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    short = _labelled(source.withColumn("text", F.sha2(_review_text(), 256)), table(spark, sf_dir, "labels"))
    return cleaning.drop_junk_reviews(cleaning.first_of_copies(keyed, "review_id", content, short))


def reviews_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_full_text(reviews(spark, sf_dir))


def with_full_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("full_text", tx.full_text(F.col("title"), F.col("review")))


def planted_effect() -> Column:
    """Effects added to the events: one arm is better throughout, one first worse and then better."""
    arm, day = F.col("user_id") % 3, event_day()
    late = (F.col("event_type") == "purchase") & (arm == 2)
    return (
        F.when((F.col("event_type") == "click") & (arm == 1), 8.0)
        .when(late & (day <= 10), -25.0)
        .when(late, 30.0)
        .otherwise(0.0)
    )


def event_day() -> Column:
    return F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1


def experiment_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value") + planted_effect()
    measured = {
        1: F.when(value > 50, 1.0).otherwise(0.0),
        2: value,
        3: F.get_json_object("props", "$.k").cast("double"),
        4: value + F.col("event_id") % 7,
    }
    metrics = F.array(
        *[F.struct(F.lit(i).alias("metric_id"), x.alias("x")) for i, x in measured.items()]
    )
    x = F.col("x").cast("decimal(12,4)")
    daily = (
        spread_table(spark, sf_dir, "events", "event_id", "event_id", "ts", "user_id", "event_type", "value", "props")
        .select(
            F.col("event_type").alias("experiment_id"),
            (F.col("user_id") % 3).cast("int").alias("arm"),
            event_day().alias("day"),
            F.explode(metrics).alias("m"),
        )
        .select("experiment_id", "arm", "day", "m.metric_id", "m.x")
        .groupBy("experiment_id", "metric_id", "arm", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    )
    # At most one row per day and arm is left here, so this window is small.
    so_far = (
        Window.partitionBy("experiment_id", "metric_id", "arm")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = daily.select(
        "experiment_id",
        "metric_id",
        "arm",
        "day",
        F.sum("n").over(so_far).cast("double").alias("cnt"),
        F.sum("sx").over(so_far).cast("double").alias("sx"),
        F.sum("sxx").over(so_far).cast("double").alias("sxx"),
    ).withColumn("mean", F.col("sx") / F.col("cnt"))
    arms = running.withColumn("variance", F.col("sxx") / F.col("cnt") - F.col("mean") * F.col("mean"))
    keys = ["experiment_id", "metric_id", "day"]
    control = arms.where("arm = 0").select(
        *keys,
        F.col("cnt").alias("count_c"),
        F.col("mean").alias("mean_c"),
        F.col("variance").alias("variance_c"),
    )
    treated = arms.where("arm > 0").select(
        *keys,
        F.col("arm").alias("variant_id"),
        F.col("cnt").alias("count_t"),
        F.col("mean").alias("mean_t"),
        F.col("variance").alias("variance_t"),
    )
    day, metric = F.col("day"), F.col("metric_id")
    lost_variance = (day % 29 == 0) & (metric > 1)
    empty_arm = (day == 1) & (metric == 4) & (F.col("variant_id") == 2)
    return treated.join(control, keys).select(
        "experiment_id",
        "variant_id",
        "metric_id",
        day.cast("double").alias("time_since_start"),
        "count_c",
        F.when(empty_arm, 0.0).otherwise(F.col("count_t")).alias("count_t"),
        "mean_c",
        "mean_t",
        F.when(~lost_variance, F.col("variance_c")).alias("variance_c"),
        "variance_t",
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given topic assignments: the category that comes with each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("review_id"), F.col("label").cast("int").alias("topic")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed prediction table for the evaluation metrics."""
    i = F.col("review_id")
    shift = F.when(i % 3 == 0, 1 + i % 2).otherwise(0)
    return reviews_keyed(spark, sf_dir).select(
        "review_id",
        "stars",
        (1 + (F.col("stars") - 1 + shift) % 5).cast("int").alias("pred"),
        (F.col("stars") >= 4).cast("int").alias("label"),
        ((i % 100).cast("double") / 100.0).alias("score"),
    )


def keyword_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords_of(reviews(spark, sf_dir))


def keywords_of(rows: DataFrame) -> DataFrame:
    """Keyword strings in stored form: five distinct words joined by ' | '."""
    long_words = F.filter(tx.word_pieces(F.col("review")), lambda w: F.length(w) >= 4)
    five = F.slice(F.sort_array(F.array_distinct(long_words)), 1, 5)
    # A condition on the five words would split every text twice.
    some = F.lower("review").rlike(r"[\p{L}\p{N}]{4}")
    return rows.where(some).select("review_id", "stars", F.array_join(five, " | ").alias("keywords"))
