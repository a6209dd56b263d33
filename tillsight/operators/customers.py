"""Customer, invoice and revenue tables built from cleaned order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.numerics import exact_sum, round_half_up
from tillsight.operators import ranking
from tillsight.sources.staging import materialize


def day(column: str = "invoice_date") -> Column:
    return F.to_date(F.col(column))


def rfm(lines: DataFrame) -> DataFrame:
    """Recency (against the newest line of all), frequency, monetary, returns.

    Lines without a customer only matter for the newest day; they form one more
    group here, so the lines are read once.
    """
    per_customer = materialize(
        lines.groupBy(F.col("customer_id").cast("bigint").alias("customer_id")).agg(
            F.max(day()).alias("last_purchase_date"),
            F.countDistinct("invoice").alias("frequency"),
            exact_sum(F.col("line_value")).alias("monetary"),
            F.bool_or("is_cancellation").alias("has_returned"),
        )
    )
    newest = per_customer.agg(F.max("last_purchase_date")).scalar()
    return per_customer.where(F.col("customer_id").isNotNull()).select(
        "customer_id",
        F.datediff(newest, "last_purchase_date").alias("recency_days"),
        "frequency",
        "monetary",
        "has_returned",
    )


def customer_spend(customer_lines: DataFrame) -> DataFrame:
    return customer_lines.groupBy("customer_id").agg(
        exact_sum(F.col("line_value")).alias("monetary"),
        F.bool_or("is_cancellation").alias("has_returned"),
    )


def returner_spend(spend: DataFrame) -> DataFrame:
    """Customers, mean and exact median spend, returners against the rest."""
    spend = materialize(spend)
    means = spend.groupBy("has_returned").agg(
        F.count(F.lit(1)).alias("num_customers"),
        round_half_up(exact_sum(F.col("monetary")) / F.count(F.lit(1)), 2).alias("avg_monetary"),
    )
    medians = ranking.exact_percentiles(spend, "monetary", {"m": 0.5}, ["has_returned"])
    return means.join(medians, "has_returned").select(
        "has_returned", "num_customers", "avg_monetary", round_half_up(F.col("m"), 2).alias("median_monetary")
    )


def modal_value(df: DataFrame, key: str, value: str, default: str = "UNKNOWN") -> DataFrame:
    """Most frequent non-null value per key, alphabetically first on a tie."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.when(F.col(value).isNotNull(), F.struct(-F.col("_n"), F.col(value).alias("v"))))
    return counts.groupBy(key).agg(F.coalesce(best["v"], F.lit(default)).alias(value))


def rank_in_country(customer_lines: DataFrame, customers: DataFrame) -> DataFrame:
    """RANK() by spend inside the country of the customer dimension."""
    spend = (
        customer_lines.groupBy("customer_id")
        .agg(exact_sum(F.col("line_value")).alias("monetary"))
        .join(customers.select("customer_id", "country"), "customer_id")
    )
    return ranking.rank_descending(materialize(spend), "monetary", ["country"], "rank_in_country")


def monthly_revenue(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.to_date(F.date_trunc("month", "invoice_date")).alias("month")).agg(
        exact_sum(F.col("line_value")).alias("revenue")
    )


def cumulative_revenue(monthly: DataFrame) -> DataFrame:
    """Running revenue. One row per month arrives here, so one task is enough."""
    running = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.select(
        "month",
        "revenue",
        F.sum(F.col("revenue").cast("decimal(28,4)")).over(running).cast("double").alias("cumulative_revenue"),
    )


def churn_features(customer_lines: DataFrame, cutoff: str) -> DataFrame:
    """Features before the cutoff and the label: no line of any kind after it."""
    at = F.to_date(F.lit(cutoff))
    before = day() < at

    def earlier(c: Column) -> Column:
        return F.when(before, c)

    # Invoices are summed up first: lines dealt by invoice stay in their tasks, as they
    # would not for distinct values of an expression over the invoice.
    per_invoice = customer_lines.groupBy("customer_id", "invoice").agg(
        F.min(earlier(day())).alias("first_day"),
        F.max(earlier(day())).alias("last_day"),
        F.bool_or(before).alias("_before"),
        F.sum(earlier(F.col("line_value")).cast("decimal(18,4)")).alias("monetary"),
        F.bool_or(earlier(F.col("is_cancellation"))).alias("has_returned"),
        F.bool_or(~before).alias("_active"),
    )
    flagged = (
        per_invoice.groupBy("customer_id")
        .agg(
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
            F.count_if(F.col("_before") & F.col("invoice").isNotNull()).alias("frequency"),
            F.sum("monetary").cast("double").alias("monetary"),
            F.bool_or("has_returned").alias("has_returned"),
            F.bool_or("_active").alias("_active"),
        )
        .where(F.col("first_day").isNotNull())
    )
    return flagged.select(
        "customer_id",
        F.datediff(at, "first_day").alias("tenure_days"),
        F.datediff(at, "last_day").alias("recency_days"),
        "frequency",
        "monetary",
        round_half_up(F.col("monetary") / F.col("frequency"), 2).alias("avg_order_value"),
        "has_returned",
        F.when(F.col("_active"), 0).otherwise(1).alias("churned"),
    )


def invoices(customer_lines: DataFrame) -> DataFrame:
    """One row per customer and invoice, cancellations marked."""
    return customer_lines.groupBy("customer_id", "invoice").agg(
        F.min(day()).alias("invoice_date"),
        exact_sum(F.col("line_value")).alias("invoice_value"),
        F.bool_or("is_cancellation").alias("is_cancellation"),
    )


def sale_invoices(customer_lines: DataFrame) -> DataFrame:
    """One row per customer and invoice, cancelled lines left out beforehand."""
    return invoices(customer_lines.where(~F.col("is_cancellation"))).drop("is_cancellation")


BAND = 0.01  # two invoice values cancel when their sum is closer to zero than this


def reversed_invoices(rolled: DataFrame) -> DataFrame:
    """Invoices that cancel another invoice of the same customer and day.

    A pair (i, j) counts when i is positive and |value_i + value_j| < BAND; both
    sides are reported. Only the existence of a partner matters, so no pairs are
    formed: the mirrored values -v are cut into cells of width BAND and each
    cell keeps its smallest and largest mirrored value. Two values in the same
    cell are always within the band; the neighbouring cells need one comparison
    with their nearest end. Every join has a unique right side, so a customer
    with very many invoices on a day costs no more than its rows.
    """
    at = ["customer_id", "invoice_date"]
    value = F.col("invoice_value")
    # An invoice this small would pair with itself; such rows are compared by
    # count among themselves and by cell with everything else.
    tiny = (value > 0) & (value < BAND / 2)
    mirror = F.floor(-value / BAND)
    cells = rolled.groupBy(*at, mirror.alias("cell")).agg(
        *[
            fold(F.when(which, -value)).alias(f"{name}_{end}")
            for name, which in (("any", ~tiny), ("pos", (value > 0) & ~tiny), ("tiny", tiny))
            for end, fold in (("lo", F.min), ("hi", F.max))
        ],
        F.count_if(tiny).alias("tiny_n"),
    )
    # Each cell answers for itself and for both neighbours.
    nearby = cells.withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select(
        *at,
        (F.col("cell") + F.col("shift")).alias("probe"),
        *[c for c in cells.columns if c not in (*at, "cell")],
    )
    # Sides of a probe cell, folded to one row: nearest mirrored values below and above it.
    folded = nearby.groupBy(*at, "probe").agg(
        *[F.array_sort(F.collect_set(F.array(f"{k}_lo", f"{k}_hi"))).alias(k) for k in ("any", "pos", "tiny")],
        F.sum("tiny_n").alias("tiny_n"),
    )
    probes = rolled.withColumn("probe", F.floor(value / BAND))
    joined = probes.join(folded, [*at, "probe"], "left")

    def hit(column: str) -> Column:
        ends = F.flatten(F.col(column))
        return F.coalesce(F.exists(ends, lambda m: F.abs(m - value) < BAND), F.lit(False))

    positive = value > 0
    partner = (
        F.when(tiny, hit("any") | (F.col("tiny_n") > 1))
        .when(positive, hit("any") | hit("tiny"))
        .otherwise(hit("pos") | hit("tiny"))
    )
    return joined.where(partner).select("invoice").distinct()


def genuine_invoices(rolled: DataFrame) -> DataFrame:
    """Sales left after reversed invoices and other cancellations are dropped.

    A reversed invoice number is dropped for every customer that carries it.
    """
    rolled = materialize(rolled)
    kept = rolled.join(reversed_invoices(rolled), "invoice", "left_anti")
    return kept.where(~F.col("is_cancellation")).drop("is_cancellation")
