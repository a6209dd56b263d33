"""Global and grouped order statistics without a single-task window.

A window ordered over a whole table, or over a group that may hold a third of
it, runs in one task. These operators sort the rows into value ranges, number
the rows inside every range in parallel and add the count of all earlier
ranges. Range totals are the only data ever ordered in one place; there is one
for each ROWS_PER_RANGE rows, and at least one per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.sources.staging import materialize

ROWS_PER_RANGE = 1_000_000
DIGEST_DIGITS = 4  # 16 ** 4 ranges when the sort key is an md5 digest


def bucket_count(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _same_keys(left: DataFrame, right: DataFrame, pairs) -> Column:
    condition = F.lit(True)
    for mine, theirs in pairs:
        condition = condition & left[mine].eqNullSafe(right[theirs])
    return condition


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join on `keys`; the right copies of the keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    joined = left.join(renamed, _same_keys(left, renamed, [(k, f"_r_{k}") for k in keys]), how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def value_ranges(df: DataFrame, value: str, at_least: int = 0) -> DataFrame:
    """Add `_b`, the number of the value range a row falls in; the rows are staged in these ranges.

    Spark samples the bounds itself. They only balance the work: equal values
    share a range, and results do not depend on where it ends. `df` should be
    staged, as it is counted and sampled first.
    """
    n = max(bucket_count(df.sparkSession), at_least, df.count() // ROWS_PER_RANGE)
    return materialize(df.repartitionByRange(n, value).withColumn("_b", F.spark_partition_id()))


def range_offsets(ranged: DataFrame, group: Sequence[str], n: Column) -> DataFrame:
    """Per group and range: rows in earlier ranges and rows of the group."""
    totals = ranged.groupBy(*group, "_b").agg(F.sum(n).alias("_in_range"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *group,
        "_b",
        F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).cast("long").alias("_before"),
        F.sum("_in_range").over(whole).cast("long").alias("n_total"),
    )


def cumulative_counts(
    df: DataFrame,
    value: str,
    group: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """One row per distinct value of each group with its cumulative count.

    Output: group columns, `value`, `n` (rows with that value), the `extra`
    aggregates, `n_le` (rows at or below it) and `n_total`. NULL values are
    left out. The distinct values are staged, as they are read three times.
    """
    extra = extra or {}
    # NULLs count as zero rows here and are dropped at the end: a filter this
    # early would travel down and repeat the expression behind `value`.
    distinct = materialize(
        df.groupBy(*group, value).agg(F.count(value).alias("n"), *[c.alias(k) for k, c in extra.items()])
    )
    ranged = value_ranges(distinct, value)
    offsets = range_offsets(ranged, group, F.col("n"))
    inside = (
        Window.partitionBy(*group, "_b")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumn("_local", F.sum("n").over(inside))
    out = attach(local, offsets, [*group, "_b"])
    kept = ["_b"] if keep_range else []
    return out.where(F.col(value).isNotNull()).select(
        *group, value, "n", *extra, (F.col("_before") + F.col("_local")).alias("n_le"), "n_total", *kept
    )


def number_rows(ranged: DataFrame, order_by: Sequence, group: Sequence[str] = ()) -> DataFrame:
    """Add `row_no` (1-based within the group) and `n_total` to rows that carry `_b`.

    `order_by` must start with the column the ranges were cut on.
    """
    offsets = range_offsets(ranged, group, F.lit(1))
    inside = Window.partitionBy(*group, "_b").orderBy(*order_by)
    local = ranged.withColumn("_local", F.row_number().over(inside))
    return (
        attach(local, offsets, [*group, "_b"])
        .withColumn("row_no", F.col("_before") + F.col("_local"))
        .drop("_b", "_local", "_before")
    )


def digest_ranges(df: DataFrame, digest: str) -> DataFrame:
    """Ranges for rows ordered by an md5 digest: its leading hex digits."""
    return df.withColumn("_b", F.substring(digest, 1, DIGEST_DIGITS))


def exact_percentiles(
    df: DataFrame, value: str, probabilities: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated percentiles per group, as PERCENTILE_CONT gives them."""
    counts = cumulative_counts(df, value, group)
    v = F.col(value).cast("double")
    first, last = F.col("n_le") - F.col("n"), F.col("n_le") - 1
    aggs = []
    for name, p in probabilities.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        for end, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggs.append(F.max(F.when(rank.between(first, last), v)).alias(f"{name}_{end}"))
        aggs.append(F.max(position - F.floor(position)).alias(f"{name}_w"))
    ends = counts.groupBy(*group).agg(*aggs) if group else counts.agg(*aggs)
    return ends.select(
        *group,
        *[
            (F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * F.col(f"{k}_w")).alias(k)
            for k in probabilities
        ],
    )


def rank_descending(df: DataFrame, value: str, group: Sequence[str], name: str) -> DataFrame:
    """RANK() with gaps, largest value first, attached to every row."""
    counts = cumulative_counts(df, value, group)
    ranks = counts.select(*group, value, (F.col("n_total") - F.col("n_le") + 1).alias(name))
    return attach(df, ranks, [*group, value], "left")


def hashed_sample(
    df: DataFrame,
    key: str,
    fraction: float,
    strata: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """Exactly round-half-even(fraction * size) rows of every stratum, no replacement.

    Rows are taken in the order of md5(seed|key). Digest ranges that start past
    the cut are dropped before anything is sorted; the rest are numbered range
    by range.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    ranged = digest_ranges(df.withColumn("_digest", digest), "_digest")
    offsets = (
        range_offsets(ranged, strata, F.lit(1))
        .withColumn("_quota", F.bround(F.col("n_total") * F.lit(float(fraction)), 0).cast("long"))
        .drop("n_total")
    )
    marked = attach(ranged, offsets, [*strata, "_b"]).where(F.col("_before") < F.col("_quota"))
    inside = Window.partitionBy(*strata, "_b").orderBy("_digest", key)
    return (
        marked.withColumn("_local", F.row_number().over(inside))
        .where(F.col("_before") + F.col("_local") <= F.col("_quota"))
        .drop("_digest", "_b", "_before", "_quota", "_local")
    )
