"""Two-sample statistics over whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import numerics as nx
from tillsight.operators import ranking
from tillsight.sources.staging import materialize


def mann_whitney(df: DataFrame, value: str, is_first: Column, continuity: bool = True) -> DataFrame:
    """Mann-Whitney U of the rows where `is_first` holds against the others.

    Average ranks and the tie correction come from per-value counts, so the
    statistic is one aggregate over distinct values. One row: sizes, U of the
    first group, z, two-sided normal p and the chance that a first-group value
    is the larger one (the area under the ROC curve).
    """
    counts = ranking.cumulative_counts(
        df.withColumn("_first", is_first.cast("int")), value, extra={"_n1": F.sum("_first")}
    )
    big = "decimal(38,0)"
    n, n1 = F.col("n").cast(big), F.col("_n1").cast(big)
    twice_rank = (2 * F.col("n_le") - F.col("n") + 1).cast("decimal(20,0)")
    folded = counts.agg(
        F.sum(F.col("_n1")).cast("double").alias("n1"),
        F.sum("n").cast("double").alias("total"),
        (F.sum(F.col("_n1").cast("decimal(18,0)") * twice_rank).cast("double") / 2.0).alias("rank_sum"),
        F.sum((n.cast("double") * n.cast("double") * n.cast("double")) - n.cast("double")).alias("ties"),
    )
    n1, total = F.col("n1"), F.col("total")
    n0 = total - n1
    spread = F.sqrt(n1 * n0 / 12.0 * ((total + 1.0) - F.col("ties") / (total * (total - 1.0))))
    parts = folded.select(
        n1.cast("bigint").alias("n_first"),
        n0.cast("bigint").alias("n_other"),
        (F.col("rank_sum") - n1 * (n1 + 1.0) / 2.0).alias("u"),
        (n1 * n0).alias("pairs"),
        spread.alias("spread"),
    ).withColumn("gap", F.col("u") - F.col("pairs") / 2.0)
    size = F.greatest(F.abs("gap") - (0.5 if continuity else 0.0), F.lit(0.0))
    scored = parts.withColumn(
        "z", F.when(F.col("spread") > 0, size / F.col("spread")).otherwise(0.0) * F.signum("gap")
    )
    return nx.with_two_sided_p(scored, "z").select(
        "n_first", "n_other", "u", "z", "p_value", (F.col("u") / F.col("pairs")).alias("auc")
    )


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and its two-sided p-value in one row.

    The p-value is that of the t distribution, see `with_correlation_p`.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    folded = both.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    return nx.with_correlation_p(folded, "r", "n").select("n", "r", "p_value")


#: Candidates per gamma draw; each is taken with a probability above 0.95, so that none is taken once in 10**15 draws.
GAMMA_TRIES = 12


def _draw(seed: int, *keys: Column) -> Column:
    """Uniform number inside (0, 1)."""
    return nx.hash_uniform(seed, *keys) + 0.5 / 4294967296.0


def gamma_draw(shape: Column, seed: int, *keys: Column) -> Column:
    """Gamma(shape, 1) number for shape >= 1, by the method of Marsaglia and Tsang (2000): the first candidate taken."""
    d = shape - 1.0 / 3.0
    c = 1.0 / F.sqrt(9.0 * d)

    def candidate(t: Column) -> Column:
        u = [_draw(seed, *keys, t, F.lit(j)) for j in (1, 2, 3)]
        x = F.sqrt(-2.0 * F.log(u[0])) * F.cos(2.0 * math.pi * u[1])
        return F.struct(x.alias("x"), (1.0 + c * x).alias("w"), F.log(u[2]).alias("l"))

    def taken(z: Column) -> Column:
        v = z["w"] * z["w"] * z["w"]
        return F.when(z["w"] > 0, z["l"] < 0.5 * z["x"] * z["x"] + d - d * v + d * F.log(v)).otherwise(False)

    first = F.filter(F.transform(F.sequence(F.lit(1), F.lit(GAMMA_TRIES)), candidate), taken)[0]["w"]
    return F.coalesce(d * first * first * first, shape)


#: Poisson(1) counts beyond this have a probability below 1e-12, less than one step of the uniform numbers used.
POISSON_LEVELS = 14
#: Draws of one task, so that the number of tasks grows with rows times replicates.
DRAWS_PER_TASK = 5_000_000


def _poisson_one(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform number."""
    total, term, count = 0.0, math.exp(-1.0), F.lit(0)
    for k in range(POISSON_LEVELS):
        term = term / k if k else term
        total += term
        count = count + (u >= F.lit(total)).cast("int")
    return count


def resampled_interval(
    df: DataFrame,
    key: str,
    value: str,
    flag: str,
    replicates: int = 1000,
    seed: int = 42,
    confidence: float = 0.95,
) -> DataFrame:
    """Percentile interval of median(flag) - median(not flag), Poisson bootstrap.

    Every row draws its weight for replicate b from md5(seed|b|key), so the
    result is the same on any cluster. A first pass only sums weights per
    replicate and value range (small after the map-side combine); the second
    pass looks at rows again only in the ranges where some replicate has its
    median. No replicate is ever sorted as a whole.
    """
    return _interval(resampled_median_differences(df, key, value, flag, replicates, seed), confidence)


def resampled_median_differences(
    df: DataFrame, key: str, value: str, flag: str, replicates: int, seed: int
) -> DataFrame:
    """b, diff: the difference of the two groups' medians when every row is drawn anew for each replicate."""
    staged = materialize(df.select(key, value, flag).where(F.col(value).isNotNull()))
    rows = ranking.value_ranges(staged, value, at_least=64)
    # Few rows make many draws: they are dealt out with their blocks of replicates, not by their own size.
    size = max(1, -(-replicates // 40))
    starts = F.sequence(F.lit(1), F.lit(replicates), F.lit(size))
    last_of = F.least(F.col("_from") + F.lit(size - 1), F.lit(replicates))

    def weighted(source: DataFrame) -> DataFrame:
        n = max(source.sparkSession.sparkContext.defaultParallelism, -(-source.count() * replicates // DRAWS_PER_TASK))
        blocks = source.withColumn("_from", F.explode(starts)).repartition(n, "_from", key)
        drawn = blocks.withColumn("b", F.explode(F.sequence(F.col("_from"), last_of))).drop("_from")
        # A column of its own, and no filter that would be pushed below it: one digest a draw instead of one a level.
        drawn = drawn.withColumn("_u", nx.hash_uniform(seed, F.col("b"), F.col(key)))
        return drawn.withColumn("w", _poisson_one(F.col("_u"))).drop("_u")

    groups = ["b", flag]
    ranges = weighted(rows).groupBy(*groups, "_b").agg(F.sum("w").alias("w"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(ranges).select(
        *groups,
        "_b",
        "w",
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("before"),
        F.sum("w").over(whole).alias("total"),
    )
    # 0-based ranks of the two middle draws; equal when the total is odd.
    lo, hi = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)

    def inside(rank: Column) -> Column:
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col("w"))

    targets = materialize(
        placed.where(inside(lo) | inside(hi)).select(*groups, "_b", "before", lo.alias("lo"), hi.alias("hi"))
    )
    needed = targets.select(flag, "_b").distinct()
    again = weighted(materialize(rows.join(needed, [flag, "_b"], "left_semi")))
    fine = (
        again.join(targets.select(*groups, "_b"), [*groups, "_b"], "left_semi")
        .groupBy(*groups, "_b", value)
        .agg(F.sum("w").alias("n"))
    )
    up_to = (
        Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = fine.withColumn("upto", F.sum("n").over(up_to)).join(targets, [*groups, "_b"])
    last = F.col("before") + F.col("upto") - 1
    first = last - F.col("n") + 1
    medians = located.groupBy(*groups).agg(
        (
            F.max(F.when(F.col("lo").between(first, last), F.col(value)))
            + F.max(F.when(F.col("hi").between(first, last), F.col(value)))
        ).alias("twice")
    )
    per_replicate = medians.groupBy("b").agg(
        F.max(F.when(F.col(flag), F.col("twice"))).alias("yes"),
        F.max(F.when(~F.col(flag), F.col("twice"))).alias("no"),
    )
    return per_replicate.where("yes IS NOT NULL AND no IS NOT NULL").select(
        "b", ((F.col("yes") - F.col("no")) / 2.0).alias("diff")
    )


def _interval(diffs: DataFrame, confidence: float) -> DataFrame:
    tail = (1.0 - confidence) / 2.0
    return diffs.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.percentile("diff", F.lit(tail)).alias("ci_low"),
        F.percentile("diff", F.lit(0.5)).alias("median_diff"),
        F.percentile("diff", F.lit(1.0 - tail)).alias("ci_high"),
    )


def bootstrap_median_difference(
    df: DataFrame, value: str, flag: str, replicates: int = 1000, seed: int = 42, confidence: float = 0.95
) -> DataFrame:
    """Percentile interval of median(flag) - median(not flag) over bootstrap samples of each group's own size.

    See `replicate_median_differences`: the work is one sort of the values,
    whatever the number of replicates.
    """
    return _interval(replicate_median_differences(df, value, flag, replicates, seed), confidence)


def replicate_median_differences(df: DataFrame, value: str, flag: str, replicates: int, seed: int) -> DataFrame:
    """b, diff: the difference of the two groups' medians in each bootstrap sample.

    A sample of n draws with replacement takes the values at n uniform places of
    the sorted group. Its middle draws are the values at the middle two order
    statistics of n uniform numbers, which are drawn as such: the lower one is
    a beta number (from two gamma numbers), the next one the least of the rest
    above it. So a replicate costs two look-ups and no pass over the rows.
    Numbers come from md5 digests of seed, replicate and group: the result is
    the same on any cluster.
    """
    counts = materialize(ranking.cumulative_counts(df.where(F.col(flag).isNotNull()), value, [flag], keep_range=True))
    n, lower = F.col("n"), F.floor((F.col("n") - 1) / 2) + 1
    sizes = counts.groupBy(flag).agg(F.max("n_total").alias("n"))
    drawn = sizes.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select(
        flag,
        "b",
        "n",
        (n - lower).alias("above"),
        gamma_draw(lower.cast("double"), seed, F.col("b"), F.col(flag), F.lit(1)).alias("g"),
        gamma_draw((n - lower + 1).cast("double"), seed, F.col("b"), F.col(flag), F.lit(2)).alias("h"),
        F.log(_draw(seed, F.col("b"), F.col(flag), F.lit(3))).alias("l"),
    )
    low = F.col("g") / (F.col("g") + F.col("h"))
    high = F.col("low") + (1.0 - F.col("low")) * (1.0 - F.exp(F.col("l") / F.col("above")))
    placed = drawn.withColumn("low", low).withColumn("high", F.when(n % 2 == 1, F.col("low")).otherwise(high))
    places = materialize(
        placed.select(flag, "b", F.posexplode(F.array("low", "high")).alias("end", "u"), "n").select(
            flag, F.struct("b", "end").alias("id"), F.least(F.floor(F.col("u") * n) + 1, n).alias("rank")
        )
    )
    ranges = counts.groupBy(flag, "_b").agg(F.max("n_le").alias("n_le"))
    in_range = materialize(_next_point(ranges, places, [flag], "n_le", "_b").withColumnRenamed("point", "_b"))
    needed = in_range.select(flag, "_b").distinct()
    near = counts.join(needed, [flag, "_b"], "left_semi")
    found = _next_point(near, in_range, [flag, "_b"], "n_le", value)
    medians = found.groupBy("id.b").agg(
        *[
            (F.sum(F.when(F.col(flag) == side, F.col("point").cast("double"))) / 2.0).alias(name)
            for name, side in (("yes", True), ("no", False))
        ]
    )
    return medians.where("yes IS NOT NULL AND no IS NOT NULL").select("b", (F.col("yes") - F.col("no")).alias("diff"))


def _next_point(points: DataFrame, targets: DataFrame, group: list[str], at: str, payload: str) -> DataFrame:
    """`targets` (group, id, rank) with `point`: the payload of the first point whose `at` is not below the rank.

    Points and targets meet in one descending order, in which every target
    takes the last point before it.
    """
    kinds = {c: t for df in (points, targets) for c, t in df.dtypes}
    nothing = lambda c: F.lit(None).cast(kinds[c])
    mine = points.select(*group, F.col(at).alias("rank"), nothing("id").alias("id"), F.col(payload).alias("point"))
    theirs = targets.select(*group, "rank", "id", nothing(payload).alias("point"))
    falling = Window.partitionBy(*group).orderBy(F.desc("rank"), F.col("id").isNotNull())
    last = F.last("point", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return mine.unionByName(theirs).withColumn("point", last).where("id is not null")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
