"""Evaluation of predictions as aggregates over whole prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.operators import stats


def _cells(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[int]) -> DataFrame:
    wide = _cells(df, actual, predicted).groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n"))
    return wide.fillna(0).select("actual", *[F.col(str(v)).alias(f"pred_{v}") for v in labels])


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class (zero where undefined)."""
    cells = _cells(df, actual, predicted)
    none = F.lit(0).cast("bigint")

    def side(label: str, is_actual, is_pred):
        return F.struct(F.col(label).alias("label"), is_actual.alias("is_actual"), is_pred.alias("is_pred"))

    sides = F.array(side("actual", F.col("n"), none), side("predicted", none, F.col("n")))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    long = cells.select(F.explode(sides).alias("s"), hit.alias("hit")).select("s.*", "hit")
    folded = long.groupBy("label").agg(
        F.sum("is_actual").alias("support"),
        F.sum("is_pred").alias("_pred"),
        F.sum(F.when(F.col("is_actual") > 0, F.col("hit")).otherwise(0)).alias("_tp"),
    )
    tp, pred, support = F.col("_tp"), F.col("_pred"), F.col("support")

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return folded.select(
        "label",
        ratio(tp, pred).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, pred + support).alias("f1"),
        "support",
    )


def overall_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and macro F1 (every class counts the same)."""
    right = df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double"))).scalar()
    return class_report(df, actual, predicted).agg(F.avg("f1").alias("macro_f1")).select(
        right.alias("accuracy"), "macro_f1"
    )


def off_by_one(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    gap = F.abs(F.col(predicted) - F.col(actual))
    return df.where(gap != 0).agg(
        F.count(F.lit(1)).alias("wrong"), F.avg((gap == 1).cast("double")).alias("off_by_one_share")
    )


def binary_scores(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall at a threshold, and the exact ROC area."""
    positive, called = F.col(label) == 1, F.col(score) > threshold
    tp = F.count_if(positive & called)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((positive == called).cast("double")).alias("accuracy"),
        F.when(F.count_if(called) > 0, tp / F.count_if(called)).otherwise(0.0).alias("precision"),
        F.when(F.count_if(positive) > 0, tp / F.count_if(positive)).otherwise(0.0).alias("recall"),
    )
    auc = stats.mann_whitney(df, score, F.col(label) == 1).select("auc").scalar()
    return counts.withColumn("roc_auc", auc)
