"""Profiles, shares and integrity checks of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.operators.cleaning import row_digest


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def dependency_check(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys have more than one distinct value."""
    per_key = df.groupBy(key).agg(F.countDistinct(value).alias("n"))
    return per_key.agg(
        F.lit(f"{key} -> {value}").alias("dependency"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("n") > 1).alias("violations"),
    )


def _long(one_row: DataFrame, names: Sequence[str], label: str, fields: Sequence[str], keep=()) -> DataFrame:
    """Turn `field__name` columns of a one-row table into one row per name."""
    items = F.array(
        *[
            F.struct(F.lit(n).alias(label), *[F.col(f"`{f}__{n}`").alias(f) for f in fields])
            for n in names
        ]
    )
    return one_row.select(*keep, F.explode(items).alias("i")).select(*keep, "i.*")


def table_profile(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows, exact duplicates, distinct values and missing values per column.

    `tasks`, if given, is the number of tasks that compare the rows, for tables with more
    rows than the session's shuffle partitions can hold.
    """
    columns = df.columns
    # Distinct counts come from (column, digest of the value) pairs grouped first, so
    # no task ever holds all values of a column, and no long text is a key.
    cells = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.sha2(F.col(c).cast("string"), 256).alias("v")) for c in columns]
            )
        ).alias("c")
    ).select("c.*")
    per_value = cells.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    per_column = per_value.groupBy("column_name").agg(
        F.count_if(F.col("v").isNotNull()).alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("n").alias("row_count"),
    )
    digests = df.select(row_digest(columns).alias("_d"))
    if tasks is not None:
        digests = digests.repartition(tasks, "_d")
    repeated = digests.groupBy("_d").agg((F.count(F.lit(1)) - 1).alias("extra"))
    duplicates = repeated.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint")).scalar()
    return per_column.select(
        "column_name",
        "row_count",
        duplicates.alias("duplicate_rows"),
        "distinct_values",
        "missing",
        F.round(100.0 * F.col("missing") / F.col("row_count"), 4).alias("pct_missing"),
    )


def date_span(df: DataFrame, column: str) -> DataFrame:
    d = F.to_date(F.col(column))
    return df.agg(
        F.min(d).alias("first_day"), F.max(d).alias("last_day"), F.countDistinct(d).alias("active_days")
    )


def rule_classes(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows matched by each rule and their share, in one pass."""
    names = list(rules)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(r).alias(f"matched__{k}") for k, r in rules.items()]
    )
    shares = {f"pct__{k}": F.round(100.0 * F.col(f"matched__{k}") / F.col("_rows"), 4) for k in names}
    return _long(counted.withColumns(shares), names, "rule", ["matched", "pct"])


def value_shares(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Counts per value and their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "n", F.round(F.col("n") / total, digits).alias("share"))


def unique_key(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))


def references(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows whose non-null key is missing from the parent."""
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    orphans = keys.join(parent.select(key), key, "left_anti")
    return orphans.agg(
        F.lit(name).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")
    )


def distinct_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(k) for k, c in columns.items()])
