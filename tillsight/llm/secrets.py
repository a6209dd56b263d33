"""Secret scan: token candidates, and a random forest that removes false positives.

Candidates are long tokens with a digit. Features of each: its length and
characters, how its characters follow each other (classes, and likelihood under
the transitions of the corpus's own frequent words), how much of it is made of
pieces of such words, its document's path, and the text beside it. The forest
is trained on labelled findings. Expressions and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.sources.staging import materialize

#: A candidate: at least 12 token characters in a row, one of them a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{12,}+"
#: Characters looked at before and after a candidate.
BEFORE, AFTER = 60, 40
KEYWORD = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential|auth)"
#: The corpus's most frequent words of 3 to 8 letters are the dictionary; pieces of GRAM letters are looked up.
DICTIONARY, GRAM = 4000, 3
#: The forest is fitted on at most so many labelled findings, those with the smallest digests.
LABELLED = 20_000
TREES, DEPTH, THRESHOLD = 40, 6, 0.5

FEATURES = [
    "length", "digits", "uppers", "symbols", "distinct_chars", "class_runs", "transition", "coverage",
    "path_depth", "path_length", "path_bucket", "assigned", "keyword_near", "quoted", "next_is_word", "before_digits",
]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, number in the text, path, value, name it is assigned to, text before and after."""
    between = F.split(F.col("_text"), CANDIDATE, -1)
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("_text")).select(
        "id",
        "path",
        F.regexp_extract_all("_text", F.lit(CANDIDATE), 0).alias("found"),
        F.transform(between, lambda p: F.right(p, F.lit(BEFORE))).alias("before"),
        F.transform(between, lambda p: F.left(p, F.lit(AFTER))).alias("after"),
    )
    each = rows.where(F.size("found") > 0).select(
        "id", "path", F.posexplode("found").alias("number", "raw"), "before", "after"
    )
    return each.select(
        "id",
        "number",
        "path",
        F.regexp_extract("raw", r"^(?:[A-Za-z_-]+[=.]+)?([A-Za-z0-9+/_.=-]*)$", 1).alias("value"),
        F.regexp_extract("raw", r"^([A-Za-z_-]+)=", 1).alias("name"),
        F.get("before", F.col("number")).alias("before"),
        F.get("after", F.col("number") + 1).alias("after"),
    )


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> DataFrame:
    """The `size` most frequent words over all texts, with their counts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word"))
    return (
        words.where(F.length("word").between(3, 8))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "word")
        .limit(size)
    )


def _grams(text: Column, n: int) -> Column:
    """All pieces of n characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """`found` with FEATURES. `known` is a dictionary (see `dictionary`), bounded by its size parameter."""
    steps = known.select(F.explode(_grams(F.concat(F.lit("^"), "word"), 2)).alias("step"), "n").groupBy("step").agg(
        F.sum("n").alias("n")
    )
    likely = steps.select("step", F.log(F.col("n") / F.sum("n").over(_all_of(F.substring("step", 1, 1)))).alias("log_p"))
    pieces = known.select(F.explode(_grams(F.col("word"), GRAM)).alias("piece")).distinct()

    # Both tables are bounded by the dictionary: at most 8 short rows for each of its words.
    base = found.withColumn("row", F.monotonically_increasing_id())
    base = materialize(base)
    plain = F.lower("value")
    walked = (
        base.select("row", F.explode(_grams(plain, 2)).alias("step"))
        .join(F.broadcast(likely), "step", "left")
        .groupBy("row")
        .agg(F.avg(F.coalesce("log_p", F.lit(-12.0))).alias("transition"))
    )
    covered = (
        base.select("row", F.explode(_grams(plain, GRAM)).alias("piece"))
        .join(F.broadcast(pieces.withColumn("hit", F.lit(1.0))), "piece", "left")
        .groupBy("row")
        .agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage"))
    )
    path = F.coalesce("path", F.lit(""))
    flag = lambda c: c.cast("double")
    return (
        base.join(walked, "row", "left")
        .join(covered, "row", "left")
        .drop("row")
        .withColumns(
            {
                "length": F.length("value").cast("double"),
                "digits": _share(F.col("value"), "[0-9]"),
                "uppers": _share(F.col("value"), "[A-Z]"),
                "symbols": _share(F.col("value"), "[^A-Za-z0-9]"),
                "distinct_chars": F.size(F.array_distinct(F.split("value", ""))) / F.greatest(F.length("value"), F.lit(1)),
                "class_runs": F.regexp_count("value", F.lit("[0-9]+|[a-z]+|[A-Z]+|[^A-Za-z0-9]+"))
                / F.greatest(F.length("value"), F.lit(1)),
                "transition": F.coalesce("transition", F.lit(-12.0)),
                "coverage": F.coalesce("coverage", F.lit(0.0)),
                "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
                "path_length": F.length(path).cast("double"),
                "path_bucket": F.pmod(F.xxhash64(path), F.lit(16)).cast("double"),
                "assigned": flag(
                    F.col("name").rlike(f"(?i){KEYWORD}$") | F.col("before").rlike(f"(?i){KEYWORD}\\s*[=:]\\s*[\"']?$")
                ),
                "keyword_near": flag(F.col("before").rlike(f"(?i){KEYWORD}")),
                "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
                "next_is_word": flag(F.col("after").rlike(r"^\W*\p{L}{2,}")),
                "before_digits": flag(F.col("before").rlike(r"[0-9]\W{0,3}$")),
            }
        )
    )


def _all_of(key: Column):
    from pyspark.sql import Window

    return Window.partitionBy(key)


#: Labels for findings whose kind is plain: known key formats and assigned values are secrets; numbers, addresses and
#: dates are not. Others stay unlabelled.
PLAIN_KINDS = (
    (r"^(?:AKIA|ASIA)[0-9A-Z]{16}$", 1.0),
    (r"^gh[pousr]_[A-Za-z0-9]{36}$", 1.0),
    (r"^xox[abprs]-[A-Za-z0-9-]{10,}$", 1.0),
    (r"^[0-9.:/-]+$", 0.0),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", 0.0),
    (r"^[A-Za-z.-]+[0-9]{0,4}\.[a-z]{2,4}$", 0.0),
)


def plain_label(value: Column, assigned: Column) -> Column:
    """1, 0, or null where neither is plain."""
    label = F.lit(None).cast("double")
    for pattern, kind in reversed(PLAIN_KINDS):
        label = F.when(value.rlike(pattern), kind).otherwise(label)
    return F.coalesce(label, F.when((assigned > 0) & value.rlike("[0-9]"), 1.0))


def fit(labelled: DataFrame, bound: int = LABELLED) -> RandomForestClassificationModel | None:
    """A forest over FEATURES from rows with `label` 0 or 1; None if one of the two is missing."""
    rows = labelled.where(F.col("label").isin(0.0, 1.0)).select(*FEATURES, "label")
    rows = materialize(rows.orderBy(F.xxhash64(*FEATURES), *FEATURES, "label").limit(bound))
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def judged(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """`rows` with `p_secret` and `is_secret`; without a model nothing is removed."""
    if model is None:
        return rows.withColumns({"p_secret": F.lit(1.0), "is_secret": F.lit(True)})
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return (
        model.transform(assembled)
        .withColumn("p_secret", vector_to_array("probability")[1])
        .withColumn("is_secret", F.col("p_secret") >= THRESHOLD)
        .drop("features", "rawPrediction", "probability", "prediction")
    )


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
) -> DataFrame:
    """All candidates of all texts with `p_secret` and `is_secret`.

    `labelled`: findings with `value`, `name`, `path`, `before`, `after` and
    `label` (1 secret, 0 not), as a reviewer would label the rows of
    `findings`. Without it, the candidates whose kind is plain (PLAIN_KINDS, or
    a value assigned to a keyword) train the forest. Null and empty texts have no
    candidates, a null path is an empty one, null and repeated ids are passed
    on. Dictionary and transitions come from all texts.
    """
    known = materialize(dictionary(docs, text_col))
    rows = materialize(featured(findings(docs, id_col, text_col, path_col), known))
    if labelled is None:
        training = rows.withColumn("label", plain_label(F.col("value"), F.col("assigned")))
    else:
        training = featured(labelled, known)
    return judged(rows, fit(training)).select(
        F.col("id").alias(id_col), "number", "value", "name", *FEATURES, "p_secret", "is_secret"
    )
