"""Customer lifetime value: purchase summaries, fits and forecasts.

The fits minimise a mean negative log-likelihood. Customers are first reduced
to weighted distinct summaries; every optimiser step is then one Spark
aggregate that evaluates all parameter vectors of the step at once. The driver
only holds the parameters and one number per vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions import numerics as nx
from tillsight.operators import stats
from tillsight.sources.staging import materialize

PENALTY = 0.001
SCALED_SPAN = 10.0  # ages are scaled so that the longest one is this long while fitting


# --- summaries ----------------------------------------------------------------


def purchase_days(invoices: DataFrame) -> DataFrame:
    """One row per customer and day with the day's total."""
    return invoices.groupBy("customer_id", F.to_date("invoice_date").alias("day")).agg(
        nx.exact_sum(F.col("invoice_value")).alias("day_value")
    )


def _summary(days: DataFrame, end: Column) -> DataFrame:
    first = F.min("day")
    folded = days.groupBy("customer_id").agg(
        first.alias("first_day"),
        F.max("day").alias("last_day"),
        (F.count(F.lit(1)) - 1).alias("frequency"),
        nx.exact_sum(F.col("day_value")).alias("_all"),
        F.min_by("day_value", "day").alias("_first_value"),
    )
    repeat_value = (F.col("_all") - F.col("_first_value")) / F.col("frequency")
    return folded.select(
        "customer_id",
        "frequency",
        F.datediff("last_day", "first_day").alias("recency"),
        F.datediff(end, F.col("first_day")).alias("T"),
        F.when(F.col("frequency") > 0, repeat_value).otherwise(0.0).alias("monetary_value"),
    )


def purchase_summary(invoices: DataFrame, observation_end: Column) -> DataFrame:
    """Repeat purchase days, recency, age (in days) and mean repeat-day value."""
    return _summary(purchase_days(invoices), observation_end)


def calibration_holdout(invoices: DataFrame, calibration_end: str, observation_end: Column) -> DataFrame:
    """Summary up to the calibration end, with what happened after it."""
    cut = F.to_date(F.lit(calibration_end))
    days = purchase_days(invoices)
    calibration = _summary(days.where(F.col("day") <= cut), cut).withColumnsRenamed(
        {
            "frequency": "frequency_cal",
            "recency": "recency_cal",
            "T": "T_cal",
            "monetary_value": "monetary_value_cal",
        }
    )
    later = days.where((F.col("day") > cut) & (F.col("day") <= observation_end))
    holdout = later.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency_holdout"),
        (nx.exact_sum(F.col("day_value")) / F.count(F.lit(1))).alias("monetary_value_holdout"),
    )
    return calibration.join(holdout, "customer_id", "left").withColumns(
        {
            "frequency_holdout": F.coalesce("frequency_holdout", F.lit(0)),
            "monetary_value_holdout": F.coalesce("monetary_value_holdout", F.lit(0.0)),
            "duration_holdout": F.datediff(observation_end, cut),
        }
    )


def repeat_buyers(summary: DataFrame, frequency: str = "frequency") -> DataFrame:
    return summary.where(F.col(frequency) > 0)


# --- optimiser over Spark aggregates --------------------------------------------


def _minimise(batch: Callable[[np.ndarray], np.ndarray], size: int, tolerance: float = 1e-8, steps: int = 300):
    """BFGS on log-parameters: the point, its value, its largest gradient, and whether it has converged.

    `batch` scores many vectors in one Spark job.

    Each step sends the central differences and a fan of step lengths along the
    search direction, so a step costs two aggregates however many parameters
    there are.
    """
    h = 1e-4
    x = np.full(size, 0.1)
    inverse = np.eye(size)

    def with_gradient(point: np.ndarray):
        probes = [point]
        for i in range(size):
            for sign in (h, -h):
                moved = point.copy()
                moved[i] += sign
                probes.append(moved)
        scores = batch(np.array(probes))
        return scores[0], (scores[1::2] - scores[2::2]) / (2.0 * h)

    value, gradient = with_gradient(x)
    if not math.isfinite(value):
        raise ValueError("the likelihood is not finite at the start")
    converged = False
    for _ in range(steps):
        direction = -inverse @ gradient
        if gradient @ direction >= 0:
            inverse, direction = np.eye(size), -gradient
        longest = np.max(np.abs(direction))
        if longest > 2.0:
            direction *= 2.0 / longest
        lengths = np.array([2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.005, 0.0005])
        scores = batch(x + lengths[:, None] * direction)
        best = int(np.nanargmin(scores))
        if not scores[best] < value:
            converged = bool(np.max(np.abs(gradient)) < 1e-3)
            break
        moved = x + lengths[best] * direction
        new_value, new_gradient = with_gradient(moved)
        s, y = moved - x, new_gradient - gradient
        if s @ y > 1e-12:
            rho = 1.0 / (s @ y)
            left = np.eye(size) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        done = value - new_value < tolerance * (1.0 + abs(new_value)) and np.max(np.abs(new_gradient)) < 1e-4
        x, value, gradient = moved, new_value, new_gradient
        if done or np.max(np.abs(gradient)) < 1e-6:
            converged = True
            break
    return x, float(value), float(np.max(np.abs(gradient))), converged


def _fit(points: DataFrame, names: Sequence[str], columns: Sequence[str], loglik: Callable, penalty: float) -> dict:
    """Fit `loglik` on rows weighted by `w`.

    A step scores all its parameter vectors in one pass: every Arrow batch turns
    into one partial sum per vector, and Spark adds the partial sums up.
    """
    wanted = points.select(*columns, "w")

    def batch(log_vectors: np.ndarray) -> np.ndarray:
        vectors = np.exp(np.clip(log_vectors, -30.0, 30.0))

        def partial_sums(frames):
            for frame in frames:
                arrays = [frame[c].to_numpy()[None, :] for c in columns]
                w = frame["w"].to_numpy()
                with np.errstate(all="ignore"):
                    scores = loglik(*[vectors[:, [j]] for j in range(len(names))], *arrays) @ w
                yield pd.DataFrame({"i": np.arange(len(vectors)), "ll": scores, "w": w.sum()})

        summed = wanted.mapInPandas(partial_sums, "i long, ll double, w double").groupBy("i")
        out = np.full(len(vectors), np.inf)
        for i, total, weight in summed.agg(F.sum("ll"), F.sum("w")).collect():
            if total is not None and math.isfinite(total):
                out[i] = -total / weight + penalty * float(np.sum(vectors[i] ** 2))
        return out

    best, value, gradient, converged = _minimise(batch, len(names))
    fitted = {k: float(v) for k, v in zip(names, np.exp(best))}
    return {**fitted, "objective": value, "gradient": gradient, "converged": converged}


def _scaled_points(summary: DataFrame, frequency: str, recency: str, age: str) -> tuple[DataFrame, float]:
    """Distinct (x, t_x, T) with weights, times scaled to a common span."""
    distinct = materialize(
        summary.groupBy(
            F.col(frequency).cast("double").alias("x"),
            F.col(recency).cast("double").alias("t_x"),
            F.col(age).cast("double").alias("age"),
        ).agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    longest = distinct.agg(F.max("age")).first()[0]
    scale = SCALED_SPAN / longest if longest else 1.0
    return distinct.withColumns({"t_x": F.col("t_x") * scale, "age": F.col("age") * scale}), scale


# --- BG/NBD -----------------------------------------------------------------------


def _bgnbd_loglik(r, alpha, a, b, x, t_x, age):
    lg = nx.log_gamma_array
    base = lg(r + x) - lg(r) + r * np.log(alpha) + lg(a + b) + lg(b + x) - lg(b) - lg(a + b + x)
    alive = -(r + x) * np.log(alpha + age)
    gone = np.log(a) - np.log(b + np.maximum(x, 1.0) - 1.0) - (r + x) * np.log(alpha + t_x)
    return base + np.where(x > 0, np.logaddexp(alive, gone), alive)


def fit_bgnbd(
    summary: DataFrame, frequency="frequency", recency="recency", age="T", penalty: float = PENALTY
) -> dict:
    """Parameters r, alpha, a, b of the beta-geometric / NBD purchase model."""
    points, scale = _scaled_points(summary, frequency, recency, age)
    fitted = _fit(points, ["r", "alpha", "a", "b"], ["x", "t_x", "age"], _bgnbd_loglik, penalty)
    fitted["alpha"] /= scale
    return fitted


def bgnbd_expected(p: dict, t: Column, x: Column, t_x: Column, age: Column, terms: int) -> Column:
    """Expected purchases in the next t days given the history."""
    r, alpha, a, b = (F.lit(p[k]) for k in ("r", "alpha", "a", "b"))
    z = t / (alpha + age + t)
    series = nx.hyp2f1(r + x, b + x, a + b + x - 1.0, z, terms)
    shrink = F.exp((r + x) * (F.log(alpha + age) - F.log(alpha + age + t)))
    numerator = (a + b + x - 1.0) / (a - 1.0) * (1.0 - shrink * series)
    odds = F.exp(F.log(a) - F.log(b + x - 1.0) + (r + x) * (F.log(alpha + age) - F.log(alpha + t_x)))
    return numerator / (1.0 + F.when(x > 0, odds).otherwise(0.0))


def terms_for(p: dict, horizon: float) -> int:
    """Series length that covers a customer of age zero."""
    return nx.series_terms(horizon / (p["alpha"] + horizon))


def predict_holdout(table: DataFrame, p: dict, horizon: float, name: str = "predicted_purchases") -> DataFrame:
    cols = [F.col(c).cast("double") for c in ("duration_holdout", "frequency_cal", "recency_cal", "T_cal")]
    return table.withColumn(name, bgnbd_expected(p, *cols, terms=terms_for(p, horizon)))


# --- Gamma-Gamma and lifetime value --------------------------------------------------


def _gamma_gamma_loglik(p, q, v, x, m):
    lg = nx.log_gamma_array
    front = lg(p * x + q) - lg(p * x) - lg(q) + q * np.log(v)
    return front + (p * x - 1.0) * np.log(m) + p * x * np.log(x) - (p * x + q) * np.log(x * m + v)


def fit_gamma_gamma(
    repeat: DataFrame, frequency="frequency", monetary="monetary_value", penalty: float = PENALTY
) -> dict:
    """Parameters p, q, v of the spend model; needs repeat buyers with spend above zero."""
    points = materialize(
        repeat.where((F.col(frequency) > 0) & (F.col(monetary) > 0))
        .groupBy(F.col(frequency).cast("double").alias("x"), F.col(monetary).alias("m"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    return _fit(points, ["p", "q", "v"], ["x", "m"], _gamma_gamma_loglik, penalty)


def expected_spend(p: dict, x: Column, m: Column) -> Column:
    return F.lit(p["p"]) * (F.lit(p["v"]) + x * m) / (F.lit(p["p"]) * x + F.lit(p["q"]) - 1.0)


def lifetime_value(
    purchases: dict, spend: dict, x: Column, t_x: Column, age: Column, m: Column,
    months: int = 3, discount: float = 0.0,
) -> Column:
    """Discounted expected spend over whole months of thirty days."""
    terms = terms_for(purchases, 30.0 * months)
    total, before = F.lit(0.0), F.lit(0.0)
    for i in range(1, months + 1):
        until = bgnbd_expected(purchases, F.lit(30.0 * i), x, t_x, age, terms)
        total = total + (until - before) / (1.0 + discount) ** i
        before = until
    return expected_spend(spend, x, m) * total


def predict_lifetime_value(summary: DataFrame, purchases: dict, spend: dict, months: int = 3) -> DataFrame:
    x, t_x, age = (F.col(c).cast("double") for c in ("frequency", "recency", "T"))
    value = lifetime_value(purchases, spend, x, t_x, age, F.col("monetary_value"), months)
    return summary.withColumn(f"predicted_clv_{months}m", value)


# --- Pareto/NBD ---------------------------------------------------------------------

_NODES, _WEIGHTS = (v.tolist() for v in np.polynomial.legendre.leggauss(40))


def _pareto_log_parts(p: dict, x: Column, t_x: Column, age: Column) -> tuple[Column, Column]:
    """Log-likelihood and the log of its still-active part.

    The part for customers who left between the last purchase and now is the
    integral of (alpha+u)^-(r+x) (beta+u)^-(s+1) over that span, taken by
    Gauss-Legendre quadrature on a logarithmic axis.
    """
    r, alpha, s, beta = p["r"], p["alpha"], p["s"], p["beta"]
    front = nx.log_gamma(r + x) - nx.log_gamma(r) + r * F.log(alpha) + s * F.log(beta)
    active = -(r + x) * F.log(alpha + age) - s * F.log(beta + age)
    start = F.log(alpha + t_x)
    half = (F.log(alpha + age) - start) / 2.0
    peak = -(r + x - 1.0) * start - (s + 1.0) * F.log(beta + t_x)
    nodes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in zip(_NODES, _WEIGHTS)])

    def add(acc, k):
        y = start + half * (k["n"] + 1.0)
        return acc + k["w"] * F.exp(-(r + x - 1.0) * y - (s + 1.0) * F.log(beta - alpha + F.exp(y)) - peak)

    area = half * F.aggregate(nodes, F.lit(0.0), add)
    left = F.when(area > 0, F.log(s) + peak + F.log(area)).otherwise(F.lit(-1e300))
    top = F.greatest(active, left)
    total = top + F.log(F.exp(active - top) + F.exp(left - top))
    return front + total, front + active


def _pareto_loglik(r, alpha, s, beta, x, t_x, age):
    lg = nx.log_gamma_array
    front = lg(r + x) - lg(r) + r * np.log(alpha) + s * np.log(beta)
    active = -(r + x) * np.log(alpha + age) - s * np.log(beta + age)
    start = np.log(alpha + t_x)
    half = (np.log(alpha + age) - start) / 2.0
    peak = -(r + x - 1.0) * start - (s + 1.0) * np.log(beta + t_x)
    area = np.zeros(np.broadcast_shapes(r.shape, x.shape))
    for node, weight in zip(_NODES, _WEIGHTS):
        y = start + half * (node + 1.0)
        area += weight * np.exp(-(r + x - 1.0) * y - (s + 1.0) * np.log(beta - alpha + np.exp(y)) - peak)
    left = np.log(s) + peak + np.log(half * area)
    return front + np.logaddexp(active, left)


def fit_pareto_nbd(
    summary: DataFrame, frequency="frequency", recency="recency", age="T", penalty: float = PENALTY
) -> dict:
    """Parameters r, alpha, s, beta of the Pareto / NBD purchase model."""
    points, scale = _scaled_points(summary, frequency, recency, age)
    fitted = _fit(points, ["r", "alpha", "s", "beta"], ["x", "t_x", "age"], _pareto_loglik, penalty)
    fitted["alpha"] /= scale
    fitted["beta"] /= scale
    return fitted


def pareto_expected(fitted: dict, t: Column, x: Column, t_x: Column, age: Column) -> Column:
    p = {k: F.lit(fitted[k]) for k in ("r", "alpha", "s", "beta")}
    total, active = _pareto_log_parts(p, x, t_x, age)
    r, alpha, s, beta = p["r"], p["alpha"], p["s"], p["beta"]
    remaining = 1.0 - F.exp((s - 1.0) * (F.log(beta + age) - F.log(beta + age + t)))
    return F.exp(active - total) * (r + x) * (beta + age) / ((alpha + age) * (s - 1.0)) * remaining


def predict_holdout_pareto(table: DataFrame, p: dict, name: str = "predicted_purchases_pareto") -> DataFrame:
    cols = [F.col(c).cast("double") for c in ("duration_holdout", "frequency_cal", "recency_cal", "T_cal")]
    return table.withColumn(name, pareto_expected(p, *cols))


def holdout_comparison(table: DataFrame, predictions: dict[str, str]) -> DataFrame:
    """Totals of each model's predictions and of the holdout, their correlation and its p-value."""
    actual = F.col("frequency_holdout").cast("double")
    rows = F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).alias("p")) for k, c in predictions.items()])
    long = table.select(actual.alias("actual"), F.explode(rows).alias("m")).select("actual", "m.*")
    totals = long.groupBy("model").agg(F.sum("p").alias("predicted"), F.sum("actual").alias("actual"))
    tests = [
        stats.pearson(long.where(F.col("model") == k), "p", "actual").select(
            F.lit(k).alias("model"), F.col("r").alias("correlation"), "p_value"
        )
        for k in predictions
    ]
    return totals.join(reduce(DataFrame.unionByName, tests), "model")
