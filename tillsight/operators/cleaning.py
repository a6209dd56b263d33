"""Cleaning rules for order lines, reviews and experiment snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions import text as tx

# Charge codes that are not merchandise (case-sensitive).
NON_PRODUCT_CODES = [
    "POST", "DOT", "C2", "D", "M", "m", "BANK CHARGES", "ADJUST", "ADJUST2",
    "AMAZONFEE", "CRUK", "PADS", "S", "B", "C3", "GIFT",
]
GIFT_CARD_PREFIX = "gift_0001_"
# Test entries.
TEST_CODES = ["TEST001", "TEST002"]
# Descriptions that mark a zero-price line as a stock note.
JUNK_DESCRIPTIONS = [
    "check", "?", "damages", "damaged", "damages?", "found", "missing",
    "sold as set on dotcom", "adjustment", "dotcom", "amazon",
    "adjust bad debt", "smashed", "mailout", "thrown away",
    "unsaleable, destroyed.", "checked", "given away", "manual",
]
# Review text rules.
DIGITS_ONLY = r"(?U)^\d+$"
PUNCTUATION_ONLY = rf"^[.?!{tx.SPACE}-]+$"
NON_ASCII_LIMIT = 0.3


def _holds(rule: Column) -> Column:
    """A rule that is NULL does not hold."""
    return F.coalesce(rule, F.lit(False))


def is_junk_line() -> Column:
    note = F.lower(tx.strip(F.col("description"))).isin(JUNK_DESCRIPTIONS)
    return _holds((F.col("price") < 0) | ((F.col("price") == 0) & _holds(note)))


def is_test_line() -> Column:
    return _holds(F.col("stock_code").isin(TEST_CODES))


def is_cancellation() -> Column:
    return F.col("invoice").startswith("C")


def is_product() -> Column:
    code = F.col("stock_code")
    return ~(code.isin(NON_PRODUCT_CODES) | code.startswith(GIFT_CARD_PREFIX))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_junk_lines(df: DataFrame) -> DataFrame:
    return df.where(~is_junk_line())


def drop_test_lines(df: DataFrame) -> DataFrame:
    return df.where(~is_test_line())


def add_line_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_cancellation": is_cancellation(),
            "is_product": is_product(),
            "line_value": F.col("quantity") * F.col("price"),
            "is_zero_value": F.col("price") == 0,
        }
    )


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Every valid order line, with or without a customer.

    The junk and test rules look at single rows, so they run before the
    duplicate removal here: the surviving rows are the same and fewer rows
    reach the shuffle.
    """
    kept = drop_exact_duplicates(drop_test_lines(drop_junk_lines(raw)))
    return add_line_flags(kept)


def customer_lines(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("customer_id").isNotNull()).withColumn(
        "customer_id", F.col("customer_id").cast("bigint")
    )


def transaction_cleaning_report(raw: DataFrame) -> DataFrame:
    """One row of counts, each rule counted on what earlier rules left."""
    columns = raw.columns
    grouped = raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    junk, test = is_junk_line(), is_test_line()
    kept = ~junk & ~test
    identified = F.col("customer_id").isNotNull()

    def tally(rule: Column) -> Column:
        return F.count_if(rule)

    counts = grouped.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"),
        tally(junk).alias("junk_rows_removed"),
        tally(~junk & test).alias("test_rows_removed"),
        tally(kept).alias("rows_after_all"),
        tally(kept & ~identified).alias("rows_missing_customer_id"),
        tally(kept & identified).alias("rows_after_customer_level"),
        tally(kept & ~is_product()).alias("non_product_rows_flagged"),
        tally(kept & is_cancellation()).alias("cancellation_rows_kept"),
    )
    shares = {
        f"pct_{c}": F.when(F.col("rows_before") > 0, F.round(100.0 * F.col(c) / F.col("rows_before"), 2))
        for c in (
            "duplicates_removed",
            "junk_rows_removed",
            "test_rows_removed",
            "rows_after_all",
            "rows_missing_customer_id",
            "rows_after_customer_level",
        )
    }
    return counts.withColumns(shares)


def _digits_only() -> Column:
    return _holds(F.col("review").rlike(DIGITS_ONLY))


def _punctuation_only() -> Column:
    return _holds(F.col("review").rlike(PUNCTUATION_ONLY))


def _not_english() -> Column:
    return _holds(tx.non_ascii_share(F.col("review")) > NON_ASCII_LIMIT)


def drop_junk_reviews(df: DataFrame) -> DataFrame:
    return df.where(~(_digits_only() | _punctuation_only() | _not_english()))


def row_digest(columns) -> Column:
    """256-bit digest of a row, null and empty values told apart."""
    values = F.array(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])
    return F.sha2(F.to_json(values), 256)


def first_of_copies(df: DataFrame, key: str, content, short: DataFrame | None = None) -> DataFrame:
    """Of rows with the same content the one with the smallest key.

    `short` may hold the same rows with digests in place of long values, which are equal where those are.
    """
    digest = row_digest(content)
    rows = df if short is None else short
    first = rows.groupBy(digest.alias("_d")).agg(F.min(key).alias("_key")).select("_key")
    return df.join(first, F.col(key) == F.col("_key"), "left_semi")


def clean_reviews(raw: DataFrame) -> DataFrame:
    return drop_exact_duplicates(drop_junk_reviews(raw))


def review_cleaning_report(raw: DataFrame) -> DataFrame:
    """One row of counts; a review may be counted by more than one rule."""
    rules = {"_digits": _digits_only(), "_points": _punctuation_only(), "_foreign": _not_english()}
    grouped = raw.groupBy(row_digest(raw.columns).alias("_d")).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.any_value(c).alias(k) for k, c in rules.items()]
    )
    junk = F.col("_digits") | F.col("_points") | F.col("_foreign")
    return grouped.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if("_digits").alias("phone_number_rows_removed"),
        F.count_if("_points").alias("punctuation_only_rows_removed"),
        F.count_if("_foreign").alias("non_english_rows_removed"),
        F.count_if(~junk).alias("rows_after"),
    )
