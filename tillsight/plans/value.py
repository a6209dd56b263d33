"""Lifetime-value tables, fits and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import clv, customers, stats
from tillsight.plans import canonical as cn
from tillsight.plans import check_sql as cs
from tillsight.plans.registry import query
from tillsight.plans.retail import GENUINE_SQL, customer_lines
from tillsight.sources.staging import materialize

# Parameters for the checks of the closed formulas; the fits have their own queries.
FIXED_PURCHASES = {"r": 1.5, "alpha": 180.0, "a": 1.8, "b": 6.0}
FIXED_SPEND = {"p": 2.5, "q": 4.0, "v": 90000.0}


def genuine(spark, sf_dir):
    return customers.genuine_invoices(customers.invoices(customer_lines(spark, sf_dir)))


def _summary_sql(rows: str, end: str) -> str:
    return f"""SELECT customer_id, COUNT(*) - 1 AS frequency,
  CAST(date_diff('day', MIN(day), MAX(day)) AS INTEGER) AS recency, CAST(date_diff('day', MIN(day), {end}) AS INTEGER) AS "T",
  CASE WHEN COUNT(*) > 1 THEN ({cs.money("v")} - arg_min(v, day)) / (COUNT(*) - 1) ELSE 0e0 END AS monetary_value
FROM {rows} GROUP BY customer_id"""


_DAYS = f"""days AS (SELECT customer_id, invoice_date AS day, {cs.money("invoice_value")} AS v FROM genuine GROUP BY 1, 2)"""
_BASE = cs.using("tx_c") + f", {GENUINE_SQL}, {_DAYS}, obs AS (SELECT MAX(day) AS e FROM days)"
_END = "(SELECT e FROM obs)"


def observation_end(invoices):
    return invoices.agg(F.max("invoice_date")).scalar()


def purchase_summary(spark, sf_dir):
    rows = materialize(genuine(spark, sf_dir))
    return clv.purchase_summary(rows, observation_end(rows))


def calibration_holdout(spark, sf_dir):
    rows = materialize(genuine(spark, sf_dir))
    return clv.calibration_holdout(rows, cn.CUTOFF, observation_end(rows))


def _money(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query("a24_observation_end", _BASE + " SELECT e AS observation_end FROM obs")
def _(spark, sf_dir):
    return genuine(spark, sf_dir).agg(F.max("invoice_date").alias("observation_end"))


@query(
    "m5_purchase_summary",
    _BASE + f", s AS ({_summary_sql('days', _END)}) SELECT * REPLACE (ROUND(monetary_value, 4) AS monetary_value) FROM s",
)
def _(spark, sf_dir):
    return _money(purchase_summary(spark, sf_dir), "monetary_value")


_CAL = f"""cal AS ({_summary_sql(f"(SELECT * FROM days WHERE day <= DATE '{cn.CUTOFF}')", f"DATE '{cn.CUTOFF}'")}),
hold AS (SELECT customer_id, COUNT(*) AS n, {cs.money("v")} / COUNT(*) AS m FROM days
  WHERE day > DATE '{cn.CUTOFF}' AND day <= {_END} GROUP BY customer_id),
ch AS (SELECT c.customer_id, frequency AS frequency_cal, recency AS recency_cal, "T" AS T_cal,
  monetary_value AS monetary_value_cal, coalesce(n, 0) AS frequency_holdout, coalesce(m, 0e0) AS monetary_value_holdout,
  CAST(date_diff('day', DATE '{cn.CUTOFF}', {_END}) AS INTEGER) AS duration_holdout
  FROM cal c LEFT JOIN hold h ON c.customer_id = h.customer_id)"""


@query(
    "m6_calibration_holdout",
    _BASE
    + f""", {_CAL} SELECT * REPLACE (ROUND(monetary_value_cal, 4) AS monetary_value_cal,
  ROUND(monetary_value_holdout, 4) AS monetary_value_holdout) FROM ch""",
)
def _(spark, sf_dir):
    return _money(calibration_holdout(spark, sf_dir), "monetary_value_cal", "monetary_value_holdout")


@query(
    "j15_holdout_activity",
    _BASE
    + f""", {_CAL} SELECT frequency_holdout, COUNT(*) AS customers FROM ch GROUP BY frequency_holdout""",
)
def _(spark, sf_dir):
    return calibration_holdout(spark, sf_dir).groupBy("frequency_holdout").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "p21_repeat_buyers",
    _BASE
    + f""", s AS ({_summary_sql('days', _END)})
SELECT * REPLACE (ROUND(monetary_value, 4) AS monetary_value) FROM s WHERE frequency > 0""",
)
def _(spark, sf_dir):
    return _money(clv.repeat_buyers(purchase_summary(spark, sf_dir)), "monetary_value")


def _correlation_p_sql(table: str, kept: str) -> str:
    """p-values of correlations r of n pairs: r = sin(u) has a density like cos(u)**(n - 3), summed by Simpson's rule."""
    steps = 20000
    weight = f"CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = lambda top: f"{top} * SUM({weight} * pow(cos({top} * k / {steps}e0), n - 3))"
    inside, all_of_it = area("asin(abs(r))"), area("(pi() / 2)")
    return (
        f"p AS (SELECT {kept}, 1 - {inside.replace('asin(abs(r)) * SUM', 'any_value(asin(abs(r))) * SUM')} / ({all_of_it}) "
        f"AS p_value FROM {table}, range({steps + 1}) t(k) GROUP BY {kept})"
    )


@query(
    "a12_spend_independence",
    _BASE
    + f""", {_CAL}, f AS (SELECT COUNT(*) AS n, corr(frequency_cal, monetary_value_cal) AS r FROM ch WHERE frequency_cal > 0),
{_correlation_p_sql("f", "n, r")}
SELECT n, ROUND(r, 6) AS r, ROUND(p_value, 6) AS p_value FROM p""",
)
def _(spark, sf_dir):
    repeat = clv.repeat_buyers(calibration_holdout(spark, sf_dir), "frequency_cal")
    found = stats.pearson(repeat, "frequency_cal", "monetary_value_cal")
    return found.select("n", F.round("r", 6).alias("r"), F.round("p_value", 6).alias("p_value"))


def _series_sql(t: str, x: str, tx: str, age: str, terms: int) -> str:
    """Expected purchases with the Gauss series summed term by term."""
    r, alpha, a, b = (repr(FIXED_PURCHASES[k]) + "e0" for k in ("r", "alpha", "a", "b"))
    z = f"({t} / ({alpha} + {age} + {t}))"
    series = (
        f"(list_reduce(list_prepend({{'k': 0e0, 'term': 1e0, 'total': 1e0}}, "
        f"list_transform(range({terms}), lambda k: {{'k': CAST(k AS DOUBLE), 'term': 0e0, 'total': 0e0}})), "
        f"lambda s, e: {{'k': e.k, 'term': s.term * ({r} + {x} + e.k) * ({b} + {x} + e.k) / "
        f"(({a} + {b} + {x} - 1 + e.k) * (e.k + 1)) * {z}, "
        f"'total': s.total + s.term * ({r} + {x} + e.k) * ({b} + {x} + e.k) / "
        f"(({a} + {b} + {x} - 1 + e.k) * (e.k + 1)) * {z}}})).total"
    )
    odds = f"({a} / ({b} + {x} - 1) * pow(({alpha} + {age}) / ({alpha} + {tx}), {r} + {x}))"
    return (
        f"(({a} + {b} + {x} - 1) / ({a} - 1) * (1 - pow(({alpha} + {age}) / ({alpha} + {age} + {t}), {r} + {x}) * {series})"
        f" / (1 + CASE WHEN {x} > 0 THEN {odds} ELSE 0 END))"
    )


_TERMS = 60


@query(
    "m7_expected_purchases_fixed",
    _BASE
    + f""", {_CAL} SELECT customer_id,
  ROUND({_series_sql("CAST(duration_holdout AS DOUBLE)", "CAST(frequency_cal AS DOUBLE)", "recency_cal", "T_cal", _TERMS)}, 6)
  AS predicted_purchases FROM ch""",
)
def _(spark, sf_dir):
    cols = [F.col(c).cast("double") for c in ("duration_holdout", "frequency_cal", "recency_cal", "T_cal")]
    expected = clv.bgnbd_expected(FIXED_PURCHASES, *cols, terms=_TERMS)
    return calibration_holdout(spark, sf_dir).select(
        "customer_id", F.round(expected, 6).alias("predicted_purchases")
    )


@query(
    "a13_fixed_comparison",
    _BASE
    + f""", {_CAL}, e AS (SELECT CAST(frequency_holdout AS DOUBLE) AS actual,
  {_series_sql("CAST(duration_holdout AS DOUBLE)", "CAST(frequency_cal AS DOUBLE)", "recency_cal", "T_cal", _TERMS)} AS predicted
  FROM ch), f AS (SELECT SUM(predicted) AS predicted, SUM(actual) AS actual, COUNT(*) AS n, corr(predicted, actual) AS r FROM e),
{_correlation_p_sql("f", "predicted, actual, n, r")}
SELECT 'BG/NBD' AS model, ROUND(predicted, 4) AS predicted, actual, ROUND(r, 6) AS correlation,
  ROUND(p_value, 6) AS p_value FROM p""",
)
def _(spark, sf_dir):
    cols = [F.col(c).cast("double") for c in ("duration_holdout", "frequency_cal", "recency_cal", "T_cal")]
    expected = clv.bgnbd_expected(FIXED_PURCHASES, *cols, terms=_TERMS)
    table = materialize(calibration_holdout(spark, sf_dir).withColumn("expected", expected))
    compared = clv.holdout_comparison(table, {"BG/NBD": "expected"})
    digits = {"predicted": 4, "correlation": 6, "p_value": 6}
    return compared.withColumns({c: F.round(c, d) for c, d in digits.items()})


_SPEND = (
    f"{FIXED_SPEND['p']}e0 * ({FIXED_SPEND['v']}e0 + frequency * monetary_value) / "
    f"({FIXED_SPEND['p']}e0 * frequency + {FIXED_SPEND['q']}e0 - 1)"
)


@query(
    "m8_lifetime_value_fixed",
    _BASE
    + f""", s AS ({_summary_sql('days', _END)})
SELECT customer_id, ROUND(({_SPEND}) * {_series_sql("90e0", "CAST(frequency AS DOUBLE)", "recency", '"T"', _TERMS)}, 2)
  AS predicted_clv_3m FROM s WHERE frequency > 0""",
)
def _(spark, sf_dir):
    repeat = clv.repeat_buyers(purchase_summary(spark, sf_dir))
    valued = clv.predict_lifetime_value(repeat, FIXED_PURCHASES, FIXED_SPEND)
    return valued.select("customer_id", F.round("predicted_clv_3m", 2).alias("predicted_clv_3m"))


def _model_row(spark, name, fitted):
    told = ("objective", "gradient", "converged")
    return spark.createDataFrame(
        [(name, k, v, *(fitted[t] for t in told)) for k, v in fitted.items() if k not in told],
        "model string, parameter string, value double, objective double, gradient double, converged boolean",
    )


@query("m7_bgnbd_fit")
def _(spark, sf_dir):
    table = materialize(calibration_holdout(spark, sf_dir))
    fitted = clv.fit_bgnbd(table, "frequency_cal", "recency_cal", "T_cal")
    return _model_row(spark, "bgnbd", fitted)


@query("m9_pareto_nbd_fit")
def _(spark, sf_dir):
    table = materialize(calibration_holdout(spark, sf_dir))
    fitted = clv.fit_pareto_nbd(table, "frequency_cal", "recency_cal", "T_cal")
    return _model_row(spark, "pareto_nbd", fitted)


@query("a13_model_comparison")
def _(spark, sf_dir):
    table = materialize(calibration_holdout(spark, sf_dir))
    horizon = float(table.agg(F.max("duration_holdout")).first()[0])
    bgnbd = clv.fit_bgnbd(table, "frequency_cal", "recency_cal", "T_cal")
    pareto = clv.fit_pareto_nbd(table, "frequency_cal", "recency_cal", "T_cal")
    scored = clv.predict_holdout_pareto(clv.predict_holdout(table, bgnbd, horizon), pareto)
    return clv.holdout_comparison(
        scored, {"BG/NBD": "predicted_purchases", "Pareto/NBD": "predicted_purchases_pareto"}
    )


def fitted_values(spark, sf_dir):
    """Three-month value of every repeat buyer, models refitted on all data."""
    repeat = materialize(clv.repeat_buyers(purchase_summary(spark, sf_dir)))
    purchases, spend = clv.fit_bgnbd(repeat), clv.fit_gamma_gamma(repeat)
    return clv.predict_lifetime_value(repeat, purchases, spend), repeat, purchases, spend


@query("m8_lifetime_value")
def _(spark, sf_dir):
    return fitted_values(spark, sf_dir)[0]


@query("k2_top_customers")
def _(spark, sf_dir):
    valued = fitted_values(spark, sf_dir)[0]
    return valued.orderBy(F.col("predicted_clv_3m").desc(), "customer_id").limit(10)
