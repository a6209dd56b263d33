"""Experiment re-analysis, two-sample statistics and planning queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tillsight.functions import numerics as nx
from tillsight.operators import customers, experiments, quality, stats
from tillsight.plans import canonical as cn
from tillsight.plans import check_sql as cs
from tillsight.plans.registry import query
from tillsight.plans.retail import customer_lines
from tillsight.sources.staging import materialize

BOOTSTRAP_REPLICATES = 1000
KEYS = "experiment_id, variant_id, metric_id"
KEY_JOIN = "USING (experiment_id, variant_id, metric_id)"
Z_CRIT = repr(nx.normal_quantile(0.975))

cs.view(
    "typed",
    ("snap",),
    "SELECT *, CASE WHEN metric_id = 1 THEN 'binary' ELSE 'continuous' END AS metric_type FROM snap",
)
_BAD_VARIANCE = "(metric_type = 'continuous' AND (variance_c IS NULL OR variance_t IS NULL))"
_EMPTY = "(coalesce(count_c = 0, false) OR coalesce(count_t = 0, false))"
cs.view("usable", ("typed",), f"SELECT * FROM typed WHERE NOT {_BAD_VARIANCE} AND NOT {_EMPTY}")
cs.view(
    "final_rows",
    ("usable",),
    f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (
      PARTITION BY {KEYS} ORDER BY time_since_start DESC) AS r FROM usable) WHERE r = 1""",
)


def _tests(relation: str) -> str:
    return f"""
SELECT * EXCLUDE (test_se), {cs.two_sided_p("z")} AS p_value,
  abs_effect - {Z_CRIT} * se AS ci_low, abs_effect + {Z_CRIT} * se AS ci_high
FROM (SELECT *, CASE WHEN test_se > 0 THEN abs_effect / test_se ELSE 0e0 END AS z FROM (
  SELECT * EXCLUDE (pooled), mean_t - mean_c AS abs_effect,
    CASE WHEN mean_c <> 0 THEN (mean_t - mean_c) / mean_c END AS rel_effect,
    CASE WHEN metric_type = 'binary' THEN sqrt(mean_c * (1 - mean_c) / count_c + mean_t * (1 - mean_t) / count_t)
      ELSE sqrt(variance_c / count_c + variance_t / count_t) END AS se,
    CASE WHEN metric_type = 'binary' THEN sqrt(pooled * (1 - pooled) * (1 / count_c + 1 / count_t))
      ELSE sqrt(variance_c / count_c + variance_t / count_t) END AS test_se
  FROM (SELECT *, CASE WHEN metric_type = 'binary'
    THEN (mean_c * count_c + mean_t * count_t) / (count_c + count_t) END AS pooled FROM {relation})))"""


cs.view("tested", ("final_rows",), _tests("final_rows"))
cs.view("series", ("usable",), _tests("usable"))


def _adjusted(relation: str, partition: str, name: str, flag: str) -> str:
    part = f"PARTITION BY {partition}" if partition else ""
    return f"""SELECT * EXCLUDE (q), least(MIN(q) OVER ({part} ORDER BY p_value
    RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e0) AS {name},
    least(MIN(q) OVER ({part} ORDER BY p_value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e0) <= 0.05e0 AS {flag}
  FROM (SELECT *, p_value * COUNT(*) OVER ({part})
    / COUNT(*) OVER ({part} ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM {relation})"""


cs.view(
    "within_adj",
    ("tested",),
    _adjusted("tested", "experiment_id", "p_adj_within_experiment", "significant_within_experiment"),
)
cs.view(
    "full_adj",
    ("within_adj",),
    _adjusted("within_adj", "", "p_adj_across_all_tests", "significant_across_all_tests"),
)

_DIGITS = {
    "count_c": 0, "count_t": 0, "mean_c": 6, "mean_t": 6, "variance_c": 6, "variance_t": 6,
    "abs_effect": 6, "rel_effect": 6, "se": 6, "z": 6, "p_value": 6, "ci_low": 6, "ci_high": 6,
    "p_adj": 6, "p_adj_within_experiment": 6, "p_adj_across_all_tests": 6,
    "final_effect": 6, "mid_effect": 6,
}


def shown(df):
    """Round measured columns so that engines can be compared digit by digit."""
    return df.select(*[F.round(c, _DIGITS[c]).alias(c) if c in _DIGITS else F.col(c) for c in df.columns])


def _shown_sql(columns: str) -> str:
    return ", ".join(
        f"ROUND({c}, {_DIGITS[c]}) AS {c}" if c in _DIGITS else c for c in columns.replace(" ", "").split(",")
    )


_SNAP = "experiment_id,variant_id,metric_id,time_since_start,count_c,count_t,mean_c,mean_t,variance_c,variance_t"
_TYPED = _SNAP + ",metric_type"
_TESTED = _TYPED + ",abs_effect,rel_effect,se,z,p_value,ci_low,ci_high"


def snapshots(spark, sf_dir):
    return cn.experiment_snapshots(spark, sf_dir)


def tested(spark, sf_dir):
    return experiments.run_tests(experiments.final_results(snapshots(spark, sf_dir)))


@query("p1_metric_types", cs.using("typed") + f"SELECT {_shown_sql(_TYPED)} FROM typed")
def _(spark, sf_dir):
    return shown(experiments.add_metric_type(snapshots(spark, sf_dir)))


@query(
    "p2_missing_variance", cs.using("typed") + f"SELECT {_shown_sql(_TYPED)} FROM typed WHERE NOT {_BAD_VARIANCE}"
)
def _(spark, sf_dir):
    return shown(experiments.drop_missing_variance(experiments.add_metric_type(snapshots(spark, sf_dir))))


@query("p3_empty_arms", cs.using("snap") + f"SELECT {_shown_sql(_SNAP)} FROM snap WHERE NOT {_EMPTY}")
def _(spark, sf_dir):
    return shown(experiments.drop_empty_arms(snapshots(spark, sf_dir)))


@query(
    "p3_drop_report",
    cs.using("typed")
    + f"""SELECT COUNT(*) AS rows_before, {cs.count_if(_BAD_VARIANCE)} AS missing_variance_dropped,
  {cs.count_if(f"NOT {_BAD_VARIANCE} AND {_EMPTY}")} AS zero_count_dropped,
  {cs.count_if(f"NOT {_BAD_VARIANCE} AND NOT {_EMPTY}")} AS rows_after FROM typed""",
)
def _(spark, sf_dir):
    return experiments.drop_report(experiments.add_metric_type(snapshots(spark, sf_dir)))


@query(
    "p4_strict_snapshots",
    cs.using("snap")
    + f"SELECT {_shown_sql(_SNAP)} FROM snap WHERE variance_c IS NOT NULL AND variance_t IS NOT NULL "
    + "AND count_c <> 0 AND count_t <> 0",
)
def _(spark, sf_dir):
    return shown(experiments.strict_snapshots(snapshots(spark, sf_dir)))


@query("s4_final_results", cs.using("final_rows") + f"SELECT {_shown_sql(_TYPED)} FROM final_rows")
def _(spark, sf_dir):
    return shown(experiments.final_results(snapshots(spark, sf_dir)))


@query(
    "w1_last_snapshot",
    cs.using("snap")
    + f"""SELECT {_shown_sql(_SNAP)} FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}
  ORDER BY time_since_start DESC) AS r FROM snap) WHERE r = 1""",
)
def _(spark, sf_dir):
    return shown(experiments.last_snapshot(snapshots(spark, sf_dir)))


@query(
    "s14_experiment_dimension",
    cs.using("snap") + "SELECT experiment_id, COUNT(*) AS results FROM snap GROUP BY experiment_id",
)
def _(spark, sf_dir):
    facts = snapshots(spark, sf_dir)
    dim = facts.select("experiment_id").distinct()
    return facts.join(dim, "experiment_id").groupBy("experiment_id").agg(F.count(F.lit(1)).alias("results"))


_T = "experiment_id,variant_id,metric_id,abs_effect,rel_effect,se,z,p_value,ci_low,ci_high"


@query(
    "t1_two_proportion_test",
    cs.using("series") + f"SELECT time_since_start, {_shown_sql(_T)} FROM series WHERE metric_type = 'binary'",
)
def _(spark, sf_dir):
    rows = experiments.usable_snapshots(snapshots(spark, sf_dir)).where("metric_type = 'binary'")
    return shown(experiments.two_proportion_test(rows).select("time_since_start", *_T.split(",")))


@query(
    "t2_welch_test",
    cs.using("series") + f"SELECT time_since_start, {_shown_sql(_T)} FROM series WHERE metric_type = 'continuous'",
)
def _(spark, sf_dir):
    rows = experiments.usable_snapshots(snapshots(spark, sf_dir)).where("metric_type = 'continuous'")
    return shown(experiments.welch_test(rows).select("time_since_start", *_T.split(",")))


@query("t3_tests", cs.using("tested") + f"SELECT {_shown_sql(_TESTED)} FROM tested")
def _(spark, sf_dir):
    return shown(tested(spark, sf_dir))


_ADJ = KEYS + ", p_value, p_adj, significant_adj"


@query(
    "t4_fdr_within_experiment",
    cs.using("tested")
    + f"SELECT {_shown_sql(_ADJ)} FROM ({_adjusted('tested', 'experiment_id', 'p_adj', 'significant_adj')})",
)
def _(spark, sf_dir):
    done = experiments.benjamini_hochberg(tested(spark, sf_dir), group=["experiment_id"])
    return shown(done.select(*_ADJ.split(", ")))


@query(
    "w4_fdr_per_series",
    cs.using("series")
    + f"SELECT time_since_start, {_shown_sql(_ADJ)} FROM ({_adjusted('series', KEYS, 'p_adj', 'significant_adj')})",
)
def _(spark, sf_dir):
    done = experiments.benjamini_hochberg(experiments.effect_series(snapshots(spark, sf_dir)), group=experiments.SERIES)
    return shown(done.select("time_since_start", *_ADJ.split(", ")))


@query(
    "w5_fdr_across_all",
    cs.using("series")
    + f"SELECT time_since_start, {_shown_sql(_ADJ)} FROM ({_adjusted('series', '', 'p_adj', 'significant_adj')})",
)
def _(spark, sf_dir):
    done = experiments.benjamini_hochberg(experiments.effect_series(snapshots(spark, sf_dir)))
    return shown(done.select("time_since_start", *_ADJ.split(", ")))


_FULL = _TESTED + (
    ",p_adj_within_experiment,significant_within_experiment,p_adj_across_all_tests,significant_across_all_tests"
)


@query("t9_reanalysis", cs.using("full_adj") + f"SELECT {_shown_sql(_FULL)} FROM full_adj")
def _(spark, sf_dir):
    return shown(experiments.reanalysis(snapshots(spark, sf_dir)))


def _summary_sql(view: str, column: str) -> str:
    raw, adj = cs.count_if("p_value < 0.05e0"), cs.count_if(f"{column} < 0.05e0")
    return f"""SELECT '{view}' AS scope, COUNT(*) AS n_tests, {raw} AS n_significant_raw, {adj} AS n_significant_fdr,
  ROUND(100e0 * {raw} / COUNT(*), 1) AS pct_significant_raw, ROUND(100e0 * {adj} / COUNT(*), 1) AS pct_significant_fdr
  FROM full_adj"""


@query(
    "a8_significance_summary",
    cs.using("full_adj")
    + _summary_sql("within", "p_adj_within_experiment")
    + " UNION ALL "
    + _summary_sql("across", "p_adj_across_all_tests"),
)
def _(spark, sf_dir):
    result = experiments.reanalysis(snapshots(spark, sf_dir))
    views = {"within": "p_adj_within_experiment", "across": "p_adj_across_all_tests"}
    return quality.union_all(
        *[
            experiments.summarise_significance(result, column).withColumn("scope", F.lit(scope))
            for scope, column in views.items()
        ]
    )


@query(
    "j16_two_corrections",
    cs.using("full_adj")
    + """SELECT significant_within_experiment, significant_across_all_tests, COUNT(*) AS n
FROM full_adj GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    result = experiments.reanalysis(snapshots(spark, sf_dir))
    return stats.value_counts(result, ["significant_within_experiment", "significant_across_all_tests"])


_POINTS = f"{KEYS}, time_since_start, abs_effect"


@query("w6_effect_series", cs.using("series") + f"SELECT {_shown_sql(_POINTS)} FROM series")
def _(spark, sf_dir):
    return shown(experiments.effect_series(snapshots(spark, sf_dir)).select(*_POINTS.split(", ")))


cs.view(
    "flags",
    ("series",),
    f"""
SELECT {KEYS}, n AS n_snapshots, final_effect, mid_effect,
  coalesce(hi > 0 AND lo < 0, false) AS sign_flip_after_early_period,
  coalesce(CASE WHEN final_effect <> 0 THEN abs(final_effect - mid_effect) / abs(final_effect) END > 0.5, false)
    AS large_drift_mid_to_final
FROM (SELECT {KEYS}, MAX(n) AS n, MAX(CASE WHEN i = n - 1 THEN abs_effect END) AS final_effect,
    MAX(CASE WHEN i = n // 2 THEN abs_effect END) AS mid_effect,
    MAX(CASE WHEN i >= greatest(1, floor(0.2e0 * n)) THEN sign(abs_effect) END) AS hi,
    MIN(CASE WHEN i >= greatest(1, floor(0.2e0 * n)) THEN sign(abs_effect) END) AS lo
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY {KEYS}) AS n,
      row_number() OVER (PARTITION BY {KEYS} ORDER BY time_since_start, abs_effect) - 1 AS i FROM series)
  GROUP BY {KEYS}) WHERE n >= 5""",
)
_FLAGS = KEYS + ", n_snapshots, final_effect, mid_effect, sign_flip_after_early_period, large_drift_mid_to_final"


def staged_snapshots(spark, sf_dir):
    return materialize(snapshots(spark, sf_dir))


def flags(found):
    return experiments.stability_flags(materialize(experiments.effect_series(found)))


@query("w7_w8_stability_flags", cs.using("flags") + f"SELECT {_shown_sql(_FLAGS)} FROM flags")
def _(spark, sf_dir):
    return shown(flags(snapshots(spark, sf_dir)))


@query(
    "j6_flags_of_significant",
    cs.using("flags", "tested")
    + f"SELECT {_shown_sql(_FLAGS)} FROM flags JOIN (SELECT {KEYS} FROM tested WHERE p_value < 0.05e0) s {KEY_JOIN}",
)
def _(spark, sf_dir):
    found = staged_snapshots(spark, sf_dir)
    final = experiments.run_tests(experiments.final_results(found))
    return shown(experiments.stability_of_significant(flags(found), final))


@query(
    "a22_stability_counts",
    cs.using("flags", "tested")
    + f"""SELECT 'significant' AS scope, COUNT(*) AS checked, {cs.count_if("sign_flip_after_early_period")} AS flipped
  FROM flags JOIN (SELECT {KEYS} FROM tested WHERE p_value < 0.05e0) s {KEY_JOIN}
UNION ALL SELECT 'all', COUNT(*), {cs.count_if("sign_flip_after_early_period")} FROM flags""",
)
def _(spark, sf_dir):
    found = staged_snapshots(spark, sf_dir)
    every = materialize(flags(found))
    final = experiments.run_tests(experiments.final_results(found))
    return experiments.stability_counts(every, experiments.stability_of_significant(every, final))


@query(
    "w10_longest_unstable_series",
    cs.using("flags", "tested")
    + f"""SELECT {_shown_sql(_POINTS)} FROM series JOIN (SELECT {KEYS} FROM flags
  JOIN (SELECT {KEYS} FROM tested WHERE p_value < 0.05e0) s {KEY_JOIN}
  WHERE sign_flip_after_early_period ORDER BY n_snapshots DESC, {KEYS} LIMIT 4) f {KEY_JOIN}""",
)
def _(spark, sf_dir):
    found = staged_snapshots(spark, sf_dir)
    series = materialize(experiments.effect_series(found))
    significant = experiments.stability_of_significant(
        experiments.stability_flags(series), experiments.run_tests(experiments.final_results(found))
    )
    return shown(experiments.longest_unstable(series, significant))


@query(
    "a23_p_value_histogram",
    cs.using("series")
    + """, span AS (SELECT MIN(p_value) AS lo, MAX(p_value) AS hi FROM series),
counted AS (SELECT CAST(least(floor((p_value - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, COUNT(*) AS n
  FROM series, span GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, ROUND(lo + (hi - lo) / 20 * b, 6) AS bin_from,
  ROUND(lo + (hi - lo) / 20 * (b + 1), 6) AS bin_to, coalesce(n, 0) AS n
FROM range(20) r(b) CROSS JOIN span LEFT JOIN counted ON b = bin""",
)
def _(spark, sf_dir):
    table = experiments.p_value_histogram(materialize(experiments.effect_series(snapshots(spark, sf_dir))))
    return table.select("bin", F.round("bin_from", 6).alias("bin_from"), F.round("bin_to", 6).alias("bin_to"), "n")


_EFFECTS = (0.006, 0.012, 0.024)
_REACH = repr((nx.normal_quantile(0.975) + nx.normal_quantile(0.8)) ** 2)


@query(
    "t5_sample_size_plan",
    cs.using("tx_c")
    + f""", rates AS (SELECT c_mktsegment AS segment, COUNT(*) AS customers,
    ROUND(CAST(count_if(invoices > 10) AS DOUBLE) / COUNT(*), 6) AS baseline_rate
  FROM (SELECT customer_id, COUNT(DISTINCT invoice) AS invoices FROM tx_c GROUP BY customer_id) f
  JOIN customer ON customer_id = c_custkey GROUP BY c_mktsegment),
h AS (SELECT *, 2 * asin(sqrt(baseline_rate + mde_absolute)) - 2 * asin(sqrt(baseline_rate)) AS h
  FROM rates, (VALUES {", ".join(f"({e!r}e0)" for e in _EFFECTS)}) m(mde_absolute))
SELECT segment, customers, baseline_rate, mde_absolute, 0.05e0 AS alpha, 0.8e0 AS power,
  CAST(ceil(2 * {_REACH} / (h * h)) AS BIGINT) AS required_n_per_arm,
  2 * CAST(ceil(2 * {_REACH} / (h * h)) AS BIGINT) AS total_required_n FROM h""",
)
def _(spark, sf_dir):
    orders = customer_lines(spark, sf_dir).groupBy("customer_id").agg(F.countDistinct("invoice").alias("invoices"))
    segments = cn.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment")
    )
    rates = (
        orders.join(segments, "customer_id")
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.round(F.count_if(F.col("invoices") > 10) / F.count(F.lit(1)), 6).alias("baseline_rate"),
        )
    )
    return experiments.sample_size_plan(rates, "baseline_rate", _EFFECTS)


# --- order-value statistics ---------------------------------------------------


def _mann_whitney_sql(relation: str, value: str, first: str) -> str:
    return f""", ranked AS (SELECT {first} AS is_first,
    RANK() OVER (ORDER BY {value}) + (COUNT(*) OVER (PARTITION BY {value}) - 1) / 2e0 AS r,
    COUNT(*) OVER (PARTITION BY {value}) AS t FROM {relation}),
mw AS (SELECT CAST(count_if(is_first) AS DOUBLE) AS n1, CAST(count_if(NOT is_first) AS DOUBLE) AS n0,
    SUM(CASE WHEN is_first THEN r ELSE 0 END) AS rank_sum, SUM(CAST(t AS DOUBLE) * t - 1) AS ties FROM ranked),
mu AS (SELECT n1, n0, rank_sum - n1 * (n1 + 1) / 2 AS u,
    sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS spread FROM mw),
mz AS (SELECT *, CASE WHEN spread > 0 THEN greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / spread ELSE 0 END
    * sign(u - n1 * n0 / 2) AS z FROM mu)
SELECT CAST(n1 AS BIGINT) AS n_first, CAST(n0 AS BIGINT) AS n_other, u, ROUND(z, 6) AS z,
  ROUND({cs.two_sided_p("z")}, 6) AS p_value, ROUND(u / (n1 * n0), 6) AS auc FROM mz"""


def _shown_test(df):
    return df.select("n_first", "n_other", "u", *[F.round(c, 6).alias(c) for c in ("z", "p_value", "auc")])


_SPEND = f"""SELECT customer_id, {cs.money("line_value")} AS monetary, BOOL_OR(is_cancellation) AS has_returned
FROM tx_c GROUP BY customer_id"""


@query(
    "t6_mann_whitney_returners",
    cs.using("tx_c") + f", spend AS ({_SPEND})" + _mann_whitney_sql("spend", "monetary", "has_returned"),
)
def _(spark, sf_dir):
    spend = customers.customer_spend(customer_lines(spark, sf_dir))
    return _shown_test(stats.mann_whitney(spend, "monetary", F.col("has_returned")))


@query(
    "t8_order_value_by_year",
    cs.using("tx_c")
    + f""", yearly AS (SELECT customer_id, invoice, year(MIN(invoice_date)) = 2000 AS later,
    {cs.money("line_value")} AS v FROM tx_c WHERE NOT is_cancellation AND year(invoice_date) IN (1999, 2000)
    GROUP BY customer_id, invoice)"""
    + _mann_whitney_sql("yearly", "v", "later"),
)
def _(spark, sf_dir):
    sales = customers.sale_invoices(customer_lines(spark, sf_dir))
    two_years = sales.where(F.year("invoice_date").isin(1999, 2000))
    return _shown_test(stats.mann_whitney(two_years, "invoice_value", F.year("invoice_date") == 2000))


_POISSON = " + ".join(
    f"CAST(u >= {total!r}e0 AS INTEGER)"
    for total in [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(stats.POISSON_LEVELS)]
)


@query(
    "t7_bootstrap_median_difference",
    cs.using("tx_c")
    + f""", spend AS ({_SPEND}),
drawn AS (SELECT b, has_returned, monetary, {_POISSON} AS w FROM (SELECT b, has_returned, monetary,
    CAST(CAST('0x' || substr(md5('42|' || b || '|' || customer_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u
  FROM spend, range(1, {BOOTSTRAP_REPLICATES + 1}) r(b))),
placed AS (SELECT *, SUM(w) OVER (PARTITION BY b, has_returned ORDER BY monetary) AS upto,
    SUM(w) OVER (PARTITION BY b, has_returned) AS total FROM drawn WHERE w > 0),
med AS (SELECT b, has_returned, (MIN(CASE WHEN upto > (total - 1) // 2 THEN monetary END)
    + MIN(CASE WHEN upto > total // 2 THEN monetary END)) / 2 AS m FROM placed GROUP BY b, has_returned),
d AS (SELECT b, MAX(CASE WHEN has_returned THEN m END) - MAX(CASE WHEN NOT has_returned THEN m END) AS diff
  FROM med GROUP BY b)
SELECT COUNT(*) AS replicates, ROUND(quantile_cont(diff, 0.025), 6) AS ci_low,
  ROUND(quantile_cont(diff, 0.5), 6) AS median_diff, ROUND(quantile_cont(diff, 0.975), 6) AS ci_high FROM d""",
)
def _(spark, sf_dir):
    spend = customers.customer_spend(customer_lines(spark, sf_dir))
    found = stats.resampled_interval(
        spend, "customer_id", "monetary", "has_returned", replicates=BOOTSTRAP_REPLICATES
    )
    return found.select("replicates", *[F.round(c, 6).alias(c) for c in ("ci_low", "median_diff", "ci_high")])


# --- profiles -----------------------------------------------------------------


@query(
    "q5_bernoulli_check",
    cs.using("snap")
    + """SELECT metric_id, ROUND(MAX(greatest(abs(variance_c - mean_c * (1 - mean_c)),
  abs(variance_t - mean_t * (1 - mean_t)))), 6) AS max_gap,
  MAX(greatest(abs(variance_c - mean_c * (1 - mean_c)), abs(variance_t - mean_t * (1 - mean_t)))) < 1e-6 AS looks_binary
FROM snap GROUP BY metric_id""",
)
def _(spark, sf_dir):
    return experiments.bernoulli_check(snapshots(spark, sf_dir))


@query(
    "q6_arms_per_experiment",
    cs.using("snap")
    + """SELECT arms, COUNT(*) AS experiments FROM (SELECT experiment_id, COUNT(DISTINCT variant_id) AS arms
FROM snap GROUP BY experiment_id) GROUP BY arms""",
)
def _(spark, sf_dir):
    return experiments.arms_per_experiment(snapshots(spark, sf_dir))


@query(
    "q6_series_length",
    cs.using("usable")
    + f"""SELECT COUNT(*) AS series, quantile_cont(d, 0.5) AS median_duration,
  CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_snapshots
FROM (SELECT MAX(time_since_start) AS d, COUNT(*) AS n FROM usable GROUP BY {KEYS})""",
)
def _(spark, sf_dir):
    return experiments.series_length(materialize(experiments.usable_snapshots(snapshots(spark, sf_dir))))


@query(
    "q7_defects_per_metric",
    cs.using("snap")
    + f"""SELECT metric_id, COUNT(*) AS snapshots,
  {cs.count_if("variance_c IS NULL OR variance_t IS NULL")} AS missing_variance, {cs.count_if(_EMPTY)} AS zero_sample
FROM snap GROUP BY metric_id""",
)
def _(spark, sf_dir):
    return experiments.defects_per_metric(snapshots(spark, sf_dir))
