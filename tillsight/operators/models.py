"""Churn and star-rating models on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tillsight.operators import boosting, metrics, ranking
from tillsight.sources.staging import discard, materialize

# The columns of the churn table.
CHURN_FEATURES = ["tenure_days", "recency_days", "frequency", "monetary", "avg_order_value", "has_returned"]
SEED = 42


#: Keys of test rows that are sent to every task rather than shuffling the rows.
TEST_KEYS = 2_000_000


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the same label shares, repeatable on any cluster."""
    test_keys = materialize(ranking.hashed_sample(df.select(key, label), key, test_share, [label], SEED).select(key))
    if test_keys.count() <= TEST_KEYS:
        test_keys = F.broadcast(test_keys)
    return df.join(test_keys, key, "left_anti"), df.join(test_keys, key, "left_semi")


# --- churn --------------------------------------------------------------------------


def churn_matrix(features: DataFrame) -> DataFrame:
    numbers = {c: F.col(c).cast("double") for c in CHURN_FEATURES if c != "has_returned"}
    flag = F.col("has_returned").cast("int").cast("double")
    return features.withColumns({**numbers, "has_returned": flag, "label": F.col("churned").cast("double")})


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=CHURN_FEATURES, outputCol="features")


def fit_churn_logistic(train: DataFrame) -> PipelineModel:
    """Standardised logistic regression with a unit L2 penalty on the summed loss."""
    n = train.count()
    return Pipeline(
        stages=[
            _assembler(),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
            LogisticRegression(featuresCol="scaled", regParam=1.0 / n, standardization=False, maxIter=100),
        ]
    ).fit(train)


def fit_churn_boosted(train: DataFrame, rounds: int = 50, depth: int = 4) -> PipelineModel:
    boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=SEED)
    return Pipeline(stages=[_assembler(), boosted]).fit(train)


def churn_risk(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Churn probability of every customer."""
    scored = model.transform(churn_matrix(features))
    return scored.select(
        "customer_id",
        F.col("label").cast("int").alias("churned"),
        vector_to_array("probability")[1].alias("churn_risk"),
    )


def evaluate_churn(name: str, model: PipelineModel, test: DataFrame) -> DataFrame:
    scored = churn_risk(model, test)
    return metrics.binary_scores(scored, "churned", "churn_risk").withColumn("model", F.lit(name))


# --- stars --------------------------------------------------------------------------


def _splitting(text: str, stop_words: Sequence[str] | None) -> list:
    """The stages that make `_words` of a text."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2, toLowercase=True),
        StopWordsRemover(
            inputCol="_tokens", outputCol="_words", **({} if stop_words is None else {"stopWords": list(stop_words)})
        ),
    ]


def with_words(df: DataFrame, text: str = "full_text", stop_words: Sequence[str] | None = None) -> DataFrame:
    """`df` with the words (`_words`) that a TF-IDF model with these stop words splits its texts into."""
    return PipelineModel(stages=_splitting(text, stop_words)).transform(df).drop("_tokens")


def fit_tfidf(
    train: DataFrame, text: str = "full_text", terms: int = 3000, stop_words: Sequence[str] | None = None
) -> PipelineModel:
    """Unit-length TF-IDF of one- and two-word terms, fitted on training rows only.

    The `terms` most frequent terms are taken, equal counts in order of the term,
    so the vocabulary does not depend on partitions. The inverse document
    frequency carries the customary + 1, so terms found in every review keep
    some weight. `stop_words` default to the usual English ones. Rows of
    `with_words` are not split again.
    """
    pairs = [
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
    ]
    # Split once: frequent words are found first, then the pairs they form.
    held = "_words" in train.columns
    words = train if held else materialize(with_words(train, text, stop_words).select("_words"))
    chosen, n = term_frequencies(words.select(F.col("_words").alias("_terms")), terms, pairs=True), words.count()
    # A model's vocabulary: at most `terms` rows.
    kept = chosen.orderBy(F.col("n").desc(), "term").collect()
    if not held:
        discard(words)
    vocabulary = CountVectorizerModel.from_vocabulary([r.term for r in kept], inputCol="_terms", outputCol="_counts")
    weights = Vectors.dense([math.log((n + 1.0) / (r.n_rows + 1.0)) + 1.0 for r in kept])
    return PipelineModel(
        stages=[
            *_splitting(text, stop_words),
            *pairs,
            vocabulary,
            ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol="features"),
        ]
    )


#: Frequent words whose pairs tasks count by number, and entries a task counts together.
FREQUENT_WORDS, COUNTED_ENTRIES = 100_000, 1 << 21


def term_frequencies(rows: DataFrame, terms: int, pairs: bool = False) -> DataFrame:
    """term, n (occurrences), n_rows (rows that hold it) of the most frequent terms of the `_terms` arrays.

    Occurrences are summed by term alone; rows are only counted for the terms
    taken, so nothing is shuffled by row and term. With `pairs`, `_terms` are
    words in their order, and words that stand side by side count as terms too.
    A pair occurs no more often than either word, so only pairs of words as
    frequent as the last of the `terms` most frequent words are counted.
    """
    counted = rows.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if pairs:
        counted = materialize(counted)
        top = counted.orderBy(F.col("n").desc()).limit(terms).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).first()
        least = top.n if top.k == terms else 1
        known = counted.where((F.col("n") >= least) & F.col("term").isNotNull()).limit(FREQUENT_WORDS + 1).toArrow()["term"].to_pylist()
        if len(known) <= FREQUENT_WORDS:
            found = _counted_pairs(rows, sorted(known)).where(F.col("n") >= least)
            return materialize(found.orderBy(F.col("n").desc(), "term").limit(terms))
        # Too many words are as rare as the last one taken.
        last = F.size("_terms") - 1
        both = F.zip_with(F.slice("_terms", 1, last), F.slice("_terms", 2, last), lambda a, b: F.concat_ws(" ", a, b))
        return term_frequencies(rows.select(F.when(last > 0, F.concat("_terms", both)).otherwise(F.col("_terms")).alias("_terms")), terms)
    chosen = materialize(counted.orderBy(F.col("n").desc(), "term").limit(terms))
    held = rows.select(F.explode(F.array_distinct("_terms")).alias("term")).join(F.broadcast(chosen), "term")
    return held.groupBy("term", "n").agg(F.count(F.lit(1)).alias("n_rows"))


def _counted_pairs(rows: DataFrame, known: list[str]) -> DataFrame:
    """term, n, n_rows of the `known` words and of the pairs that they form side by side."""
    m = len(known)

    def added(parts: list) -> pa.RecordBatch:
        code, times = (np.concatenate(x) for x in zip(*parts))
        terms, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, times, len(terms)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (terms, n, np.bincount(at, minlength=len(terms)))], ["code", "n", "n_rows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, held = pa.array(known, pa.string()), [], 0
        for batch in batches:
            lists = batch.column(0)
            words = lists.flatten()
            at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            one = np.flatnonzero(at >= 0)
            two = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (row[1:] == row[:-1]))
            code = np.concatenate([at[one], m + at[two] * m + at[two + 1]])
            # By row and term: m * (m + 1) codes for each of a batch's rows.
            both, times = np.unique(np.concatenate([row[one], row[two]]) * (m * (m + 1)) + code, return_counts=True)
            parts.append((both % (m * (m + 1)), times))
            held += len(both)
            if held > COUNTED_ENTRIES:
                yield added(parts)
                parts, held = [], 0
        if held:
            yield added(parts)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_pylist()
            terms = [known[c] if c < m else f"{known[c // m - 1]} {known[c % m]}" for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *batch.columns[1:]], ["term", "n", "n_rows"])

    counts = rows.select("_terms").mapInArrow(count, "code long, n long, n_rows long")
    summed = counts.groupBy("code").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))
    return summed.mapInArrow(named, "term string, n long, n_rows long") if m else summed.select(
        F.lit("").alias("term"), "n", "n_rows"
    )


def staged_features(tfidf: PipelineModel, rows: DataFrame) -> DataFrame:
    """features and stars of the reviews, written once: a fit reads its rows more than once.

    Rows that hold their words (`with_words`) are counted by number, batch by
    batch, with the same results as the model's stages.
    """
    if "_words" not in rows.columns:
        return materialize(tfidf.transform(rows).select("features", "stars"))
    plain = "type tinyint, size int, indices array<int>, values array<double>"
    vectors = _vectors(tfidf.stages[4].vocabulary, tfidf.stages[5].getScalingVec().toArray())
    schema = StructType([StructField("features", VectorUDT()), rows.schema["stars"]])
    found = rows.select("_words", "stars").mapInArrow(vectors, f"features struct<{plain}>, stars {rows.schema['stars'].dataType.simpleString()}")
    return materialize(found, schema)


def _vectors(vocabulary: list[str], weights: np.ndarray):
    """A function of batches of words and stars: unit-length weighted counts of the vocabulary's words and pairs, and stars."""
    split = [t.split(" ") for t in vocabulary]
    known = sorted({w for t in split for w in t})
    number, m, size = {w: i for i, w in enumerate(known)}, len(known), len(vocabulary)
    # A term's code: that of its word, or after these that of its pair.
    codes = np.array([number[t[0]] if len(t) == 1 else m + number[t[0]] * m + number[t[1]] for t in split], np.int64)
    order = np.argsort(codes)
    ordered = codes[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(known, pa.string())
        for batch in batches:
            lists, n = batch.column(0), batch.num_rows
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            one = np.flatnonzero(at >= 0)
            two = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (row[1:] == row[:-1]))
            code, rows = np.concatenate([at[one], m + at[two] * m + at[two + 1]]), np.concatenate([row[one], row[two]])
            place = np.minimum(np.searchsorted(ordered, code), max(size - 1, 0))
            hit = np.flatnonzero(ordered[place] == code) if size else np.empty(0, np.int64)
            cell, times = np.unique(rows[hit] * max(size, 1) + order[place[hit]], return_counts=True)
            rows, index = cell // max(size, 1), cell % max(size, 1)
            values = times * weights[index]
            # Added up in order, as the model's stages do.
            norm = np.sqrt(np.bincount(rows, values * values, n))
            values = values / norm[rows]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32())
            parts = [
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(index, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(values)),
            ]
            features = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([features, batch.column(1)], ["features", "stars"])

    return count


def on_features(tfidf: PipelineModel, model: PipelineModel) -> PipelineModel:
    """The part of a star model that comes after the features."""
    return PipelineModel(stages=model.stages[len(tfidf.stages) :])


def fit_star_linear(
    tfidf: PipelineModel, train: DataFrame, iterations: int = 100, features: DataFrame | None = None
) -> PipelineModel:
    """Multinomial logistic regression on the TF-IDF features (`features`: those of `train`, if staged already)."""
    features = staged_features(tfidf, train) if features is None else features
    rows = features.select("features", F.col("stars").cast("double").alias("label"))
    n = train.count()
    model = LogisticRegression(
        family="multinomial", regParam=1.0 / n, standardization=False, maxIter=iterations, predictionCol="prediction"
    ).fit(rows)
    return PipelineModel(stages=[*tfidf.stages, model])


def fit_star_boosted(
    tfidf: PipelineModel, train: DataFrame, rounds: int = 20, depth: int = 4, features: DataFrame | None = None
) -> PipelineModel:
    """Boosted trees of each star rating against the others, grown side by side over the terms that rows hold."""
    features = staged_features(tfidf, train) if features is None else features
    rows = features.select("features", (F.col("stars") - 1).alias("label"))
    stars = features.agg(F.max("stars")).first()[0]
    model = boosting.fit_boosted_labels(rows, "label", stars, rounds, depth)
    shift = SQLTransformer(statement="SELECT *, prediction + 1.0D AS stars_predicted FROM __THIS__")
    return PipelineModel(stages=[*tfidf.stages, model, shift])


def predicted_stars(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    scored = model.transform(df)
    column = "stars_predicted" if "stars_predicted" in scored.columns else "prediction"
    return scored.select(*keep, F.col(column).cast("int").alias("predicted_stars"))


def star_scorer(model: PipelineModel):
    """A fitted star model as a scorer for whole reviews or single sentences."""

    def score(df: DataFrame, text: str) -> DataFrame:
        renamed = df.withColumn("full_text", F.col(text)) if text != "full_text" else df
        keep = ["_digest"] if "_digest" in df.columns else df.columns
        return predicted_stars(model, renamed, keep)

    return score


def evaluate_stars(name: str, model: PipelineModel, test: DataFrame) -> DataFrame:
    scored = predicted_stars(model, test, ["stars"])
    return metrics.overall_scores(scored, "stars", "predicted_stars").withColumn("model", F.lit(name))


def better_model(scores: DataFrame) -> str:
    """The name of the model with the higher accuracy, then macro F1, then the smaller name."""
    return scores.orderBy(F.col("accuracy").desc(), F.col("macro_f1").desc(), "model").first().model
