"""Analysis of A/B-test snapshots: typing, tests, correction, stability, planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import numerics as nx
from tillsight.operators import ranking
from tillsight.sources.staging import materialize

SERIES = ["experiment_id", "variant_id", "metric_id"]
# Metric ids and their types.
BINARY_METRICS = [1]
CONTINUOUS_METRICS = [2, 3, 4]


def add_metric_type(df: DataFrame) -> DataFrame:
    m = F.col("metric_id")
    unknown = F.raise_error(F.concat(F.lit("unknown metric_id "), m.cast("string")))
    return df.withColumn(
        "metric_type",
        F.when(m.isin(BINARY_METRICS), "binary").when(m.isin(CONTINUOUS_METRICS), "continuous").otherwise(unknown),
    )


def lacks_variance() -> Column:
    missing = F.col("variance_c").isNull() | F.col("variance_t").isNull()
    return (F.col("metric_type") == "continuous") & missing


def has_empty_arm() -> Column:
    return F.col("count_c").eqNullSafe(F.lit(0.0)) | F.col("count_t").eqNullSafe(F.lit(0.0))


def drop_missing_variance(df: DataFrame) -> DataFrame:
    """Only continuous metrics need a variance."""
    return df.where(~lacks_variance())


def drop_empty_arms(df: DataFrame) -> DataFrame:
    return df.where(~has_empty_arm())


def strict_snapshots(df: DataFrame) -> DataFrame:
    """The loading variant: a variance for every metric and no empty arm."""
    return df.dropna(subset=["variance_c", "variance_t"]).where((F.col("count_c") != 0) & (F.col("count_t") != 0))


def drop_report(df: DataFrame) -> DataFrame:
    """Rows each snapshot filter removes, counted one after the other."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(lacks_variance()).alias("missing_variance_dropped"),
        F.count_if(~lacks_variance() & has_empty_arm()).alias("zero_count_dropped"),
        F.count_if(~lacks_variance() & ~has_empty_arm()).alias("rows_after"),
    )


def usable_snapshots(df: DataFrame) -> DataFrame:
    return drop_empty_arms(drop_missing_variance(add_metric_type(df)))


def last_snapshot(df: DataFrame) -> DataFrame:
    """The row at the largest time per series, as an aggregate.

    max(struct) combines on the map side and never sorts a series; equal times
    are settled by the remaining columns.
    """
    rest = [c for c in df.columns if c not in SERIES and c != "time_since_start"]
    newest = F.max(F.struct("time_since_start", *rest)).alias("s")
    return df.groupBy(*SERIES).agg(newest).select(*SERIES, "s.*")


def final_results(df: DataFrame) -> DataFrame:
    return df.transform(usable_snapshots).transform(last_snapshot)


_PARTS = ["_test_se", "_ci_se"]


def _finish(df: DataFrame, alpha: float) -> DataFrame:
    """Effect, z, p and interval from the two standard errors.

    One column builds on another in separate steps: a single nested expression
    would repeat the standard errors in every place that uses them.
    """
    test_se, base = F.col("_test_se"), F.col("mean_c")
    margin = nx.normal_quantile(1.0 - alpha / 2.0) * F.col("_ci_se")
    effects = df.withColumn("abs_effect", F.col("mean_t") - base)
    scored = effects.withColumns(
        {
            "rel_effect": F.when(base != 0, F.col("abs_effect") / base),
            "se": F.col("_ci_se"),
            "z": F.when(test_se > 0, F.col("abs_effect") / test_se).otherwise(0.0),
        }
    )
    tested = nx.with_two_sided_p(scored, "z")
    return tested.withColumns(
        {"ci_low": F.col("abs_effect") - margin, "ci_high": F.col("abs_effect") + margin}
    ).drop(*_PARTS)


def _pooled_rate() -> Column:
    n_c, n_t = F.col("count_c"), F.col("count_t")
    return (F.col("mean_c") * n_c + F.col("mean_t") * n_t) / (n_c + n_t)


def _proportion_errors(pooled: Column) -> tuple[Column, Column]:
    n_c, n_t, p_c, p_t = (F.col(c) for c in ("count_c", "count_t", "mean_c", "mean_t"))
    test_se = F.sqrt(pooled * (1.0 - pooled) * (1.0 / n_c + 1.0 / n_t))
    return test_se, F.sqrt(p_c * (1.0 - p_c) / n_c + p_t * (1.0 - p_t) / n_t)


def _welch_error() -> Column:
    return F.sqrt(F.col("variance_c") / F.col("count_c") + F.col("variance_t") / F.col("count_t"))


def two_proportion_test(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pooled standard error for the test, unpooled for the interval."""
    test_se, ci_se = _proportion_errors(F.col("_pooled"))
    rows = df.withColumn("_pooled", _pooled_rate())
    return _finish(rows.withColumns({"_test_se": test_se, "_ci_se": ci_se}).drop("_pooled"), alpha)


def welch_test(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Unequal variances, normal approximation."""
    rows = df.withColumn("_ci_se", _welch_error()).withColumn("_test_se", F.col("_ci_se"))
    return _finish(rows, alpha)


def run_tests(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Test every row according to its metric type. Empty arms raise."""
    is_binary = F.col("metric_type") == "binary"
    test_se, ci_se = _proportion_errors(F.col("_pooled"))
    rows = df.withColumn("_pooled", F.when(is_binary, _pooled_rate())).withColumn("_welch", F.when(~is_binary, _welch_error()))
    errors = {
        "_test_se": F.when(is_binary, test_se).otherwise(F.col("_welch")),
        "_ci_se": F.when(is_binary, ci_se).otherwise(F.col("_welch")),
    }
    return _finish(rows.withColumns(errors).drop("_pooled", "_welch"), alpha)


def benjamini_hochberg(
    df: DataFrame,
    p: str = "p_value",
    group: Sequence[str] = (),
    alpha: float = 0.05,
    adjusted: str = "p_adj",
    significant: str = "significant_adj",
) -> DataFrame:
    """False-discovery-rate adjusted p-values within each group, or over all rows."""
    values = adjusted_values(df, p, group, adjusted)
    return ranking.attach(df, values, [*group, p], "left").withColumn(significant, F.col(adjusted) <= alpha)


def adjusted_values(df: DataFrame, p: str, group: Sequence[str], adjusted: str) -> DataFrame:
    """The adjusted value of every distinct p-value of each group.

    p * m / i with i the number of p-values at or below p, then the smallest
    such value at or above p. Ties share one value, so nothing depends on row
    order, and neither the ranks nor the running minimum need a window over a
    whole group.
    """
    ranked = ranking.cumulative_counts(df, p, group, keep_range=True).withColumn(
        "_q", F.col(p) * F.col("n_total") / F.col("n_le")
    )
    later = (
        Window.partitionBy(*group).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    )
    tails = ranked.groupBy(*group, "_b").agg(F.min("_q").alias("_low")).select(
        *group, "_b", F.min("_low").over(later).alias("_later")
    )
    from_here = (
        Window.partitionBy(*group, "_b").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    local = ranked.withColumn("_here", F.min("_q").over(from_here))
    return ranking.attach(local, tails, [*group, "_b"]).select(
        *group, p, F.least("_here", "_later", F.lit(1.0)).alias(adjusted)
    )


def reanalysis(snapshots: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Last snapshots, tested, with both views of the multiple-testing correction."""
    tested = materialize(run_tests(final_results(snapshots), alpha))
    within, across = "p_adj_within_experiment", "p_adj_across_all_tests"
    both = ranking.attach(
        tested, adjusted_values(tested, "p_value", ["experiment_id"], within), ["experiment_id", "p_value"], "left"
    )
    both = ranking.attach(both, adjusted_values(tested, "p_value", [], across), ["p_value"], "left")
    return both.withColumns(
        {
            "significant_within_experiment": F.col(within) <= alpha,
            "significant_across_all_tests": F.col(across) <= alpha,
        }
    )


def summarise_significance(df: DataFrame, adjusted: str = "p_adj", p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Counts and shares below alpha (strictly), raw and adjusted."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.count_if(F.col(p) < alpha).alias("n_significant_raw"),
        F.count_if(F.col(adjusted) < alpha).alias("n_significant_fdr"),
    )

    def share(c: str) -> Column:
        return F.when(F.col("n_tests") > 0, F.round(100.0 * F.col(c) / F.col("n_tests"), 1))

    return counts.withColumns(
        {"pct_significant_raw": share("n_significant_raw"), "pct_significant_fdr": share("n_significant_fdr")}
    )


def effect_series(snapshots: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The effect at every usable snapshot, not only the last."""
    return run_tests(usable_snapshots(snapshots), alpha)


def stability_flags(
    series: DataFrame, min_snapshots: int = 5, early_share: float = 0.2, drift_threshold: float = 0.5
) -> DataFrame:
    """Sign flips after the early period and drift from the middle to the end.

    Rows are numbered range by range (see ranking), then one aggregate per
    series picks the middle and last effect and the signs seen late.
    """
    ranged = ranking.value_ranges(series.select(*SERIES, "time_since_start", "abs_effect"), "time_since_start")
    numbered = ranking.number_rows(ranged, ["time_since_start", "abs_effect"], SERIES)
    index, n, effect = F.col("row_no") - 1, F.col("n_total"), F.col("abs_effect")
    late = index >= F.greatest(F.lit(1), F.floor(F.lit(early_share) * n))
    folded = numbered.groupBy(*SERIES).agg(
        F.max("n_total").alias("n_snapshots"),
        F.max(F.when(index == n - 1, effect)).alias("final_effect"),
        F.max(F.when(index == F.floor(n / 2), effect)).alias("mid_effect"),
        F.max(F.when(late, F.signum(effect))).alias("_top"),
        F.min(F.when(late, F.signum(effect))).alias("_bottom"),
    )
    final, mid = F.col("final_effect"), F.col("mid_effect")
    drift = F.when(final != 0, F.abs(final - mid) / F.abs(final))
    return folded.where(F.col("n_snapshots") >= min_snapshots).select(
        *SERIES,
        "n_snapshots",
        "final_effect",
        "mid_effect",
        F.coalesce((F.col("_top") > 0) & (F.col("_bottom") < 0), F.lit(False)).alias("sign_flip_after_early_period"),
        F.coalesce(drift > drift_threshold, F.lit(False)).alias("large_drift_mid_to_final"),
    )


def stability_of_significant(flags: DataFrame, tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    significant = tested.where(F.col("p_value") < alpha).select(*SERIES)
    return flags.join(significant, SERIES, "left_semi")


def stability_counts(flags: DataFrame, significant_flags: DataFrame) -> DataFrame:
    def counted(df: DataFrame, scope: str) -> DataFrame:
        return df.agg(
            F.lit(scope).alias("scope"),
            F.count(F.lit(1)).alias("checked"),
            F.count_if("sign_flip_after_early_period").alias("flipped"),
        )

    return counted(significant_flags, "significant").unionByName(counted(flags, "all"))


def longest_unstable(series: DataFrame, flags: DataFrame, n: int = 4) -> DataFrame:
    """Points of the `n` most heavily monitored series whose sign flipped."""
    picks = (
        flags.where("sign_flip_after_early_period")
        .orderBy(F.col("n_snapshots").desc(), *SERIES)
        .limit(n)
        .select(*SERIES)
    )
    return series.join(picks, SERIES, "left_semi").select(*SERIES, "time_since_start", "abs_effect")


def p_value_histogram(df: DataFrame, p: str = "p_value", bins: int = 20) -> DataFrame:
    """Equal bins from the smallest to the largest value, empty bins included."""
    span = df.agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    slot = F.least(F.floor((F.col(p) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(p).isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_from"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def sample_size_plan(
    baselines: DataFrame, rate: str, effects: Sequence[float], alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Customers needed per arm for each baseline rate and detectable effect."""
    reach = (nx.normal_quantile(1.0 - alpha / 2.0) + nx.normal_quantile(power)) ** 2
    planned = baselines.withColumn("mde_absolute", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    p1 = F.col(rate)
    p2 = p1 + F.col("mde_absolute")
    h = 2.0 * F.asin(F.sqrt(p2)) - 2.0 * F.asin(F.sqrt(p1))
    feasible = p2.between(0.0, 1.0) & (h != 0)
    per_arm = F.when(feasible, F.ceil(2.0 * F.lit(reach) / (h * h))).cast("bigint")
    return planned.withColumns(
        {
            "alpha": F.lit(alpha),
            "power": F.lit(power),
            "required_n_per_arm": per_arm,
            "total_required_n": 2 * per_arm,
        }
    )


# --- profiles ---------------------------------------------------------------


def bernoulli_check(df: DataFrame) -> DataFrame:
    """Largest gap between the variance and mean * (1 - mean) per metric."""

    def gap(arm: str) -> Column:
        m = F.col(f"mean_{arm}")
        return F.abs(F.col(f"variance_{arm}") - m * (1.0 - m))

    widest = F.max(F.greatest(gap("c"), gap("t")))
    return df.groupBy("metric_id").agg(
        F.round(widest, 6).alias("max_gap"), (widest < 1e-6).alias("looks_binary")
    )


def arms_per_experiment(df: DataFrame) -> DataFrame:
    arms = df.groupBy("experiment_id").agg(F.countDistinct("variant_id").alias("arms"))
    return arms.groupBy("arms").agg(F.count(F.lit(1)).alias("experiments"))


def series_length(df: DataFrame) -> DataFrame:
    """Median duration and number of snapshots over all series."""
    per_series = df.groupBy(*SERIES).agg(
        F.max("time_since_start").alias("duration"), F.count(F.lit(1)).cast("double").alias("snapshots")
    )
    durations = ranking.exact_percentiles(per_series, "duration", {"median_duration": 0.5})
    lengths = ranking.exact_percentiles(per_series, "snapshots", {"median_snapshots": 0.5})
    return per_series.agg(F.count(F.lit(1)).alias("series")).select(
        "series",
        durations.scalar().alias("median_duration"),
        lengths.scalar().alias("median_snapshots"),
    )


def defects_per_metric(df: DataFrame) -> DataFrame:
    return df.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count_if(F.col("variance_c").isNull() | F.col("variance_t").isNull()).alias("missing_variance"),
        F.count_if(has_empty_arm()).alias("zero_sample"),
    )
