"""Additive attributions of model output to features.

Exact interventional Shapley values: a coalition takes its features from the
explained row and the others from a background row, and a feature's value is
the weighted mean change it makes. All coalitions are expanded beside their row
and folded again by one aggregate, so rows stay independent of each other. The
background is a bounded sample that travels as a literal.

Sums of decision trees need no expansion: a leaf is reached by a mixed row if the
explained row fits the conditions of all coalition members and the background row
all others, so the leaf's part in every value follows from which conditions each
of the two rows fits. For all background rows together that is a small table per
leaf, looked up by the explained row's own pattern.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.operators import ranking

MAX_BACKGROUND = 100


def background_rows(df: DataFrame, key: str, features: Sequence[str], size: int = MAX_BACKGROUND) -> list[tuple]:
    """At most `size` rows in md5 order of the key; the sample is the feature here."""
    if size > MAX_BACKGROUND:
        raise ValueError(f"at most {MAX_BACKGROUND} background rows")
    order = F.md5(F.concat_ws("|", F.lit("background"), F.col(key).cast("string")))
    rows = df.orderBy(order, key).limit(size).select(*[F.col(c).cast("double") for c in features]).collect()
    return [tuple(r) for r in rows]


def _coefficients(n: int, feature: int) -> list[float]:
    """Weight of every coalition's output in the Shapley value of one feature."""
    out = []
    for coalition in range(2**n):
        size = bin(coalition).count("1")
        if coalition >> feature & 1:
            out.append(math.factorial(size - 1) * math.factorial(n - size) / math.factorial(n))
        else:
            out.append(-math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n))
    return out


def shapley_values(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    background: Sequence[tuple],
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """key, phi_<feature>..., base_value and output; base + sum(phi) = output.

    `score` adds a double column `_score` to rows that carry the features.
    """
    n, size = len(features), len(background)
    base_rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in background])
    # Rows are spread by key before they grow, so the expansion runs everywhere
    # and the final aggregate needs no further shuffle. The explicit number
    # keeps small inputs from being merged into one task.
    tasks = ranking.bucket_count(df.sparkSession)
    spread = df.select(key, *[F.col(c).cast("double").alias(f"_x_{c}") for c in features]).repartition(tasks, key)
    spread = spread.withColumn("_bg", F.explode(base_rows)).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1)))
    )
    mixed = spread.select(
        key,
        "_s",
        *[
            F.when(F.col("_s").bitwiseAND(1 << i) != 0, F.col(f"_x_{c}")).otherwise(F.col("_bg")[i]).alias(c)
            for i, c in enumerate(features)
        ],
    )
    scored = score(mixed)
    value = F.col("_score") / float(size)

    def weighted(i: int) -> Column:
        weights = F.array(*[F.lit(w) for w in _coefficients(n, i)])
        return F.sum(value * F.element_at(weights, F.col("_s") + 1))

    return scored.groupBy(key).agg(
        *[weighted(i).alias(f"phi_{c}") for i, c in enumerate(features)],
        F.sum(F.when(F.col("_s") == 0, value)).alias("base_value"),
        F.sum(F.when(F.col("_s") == 2**n - 1, value)).alias("output"),
    )


#: A decision tree: a leaf's value, or (feature, threshold, tree up to the threshold, tree above it).
Tree = float | tuple


def parse_trees(text: str) -> list[Tree]:
    """The weighted trees of an ensemble from its `toDebugString`."""
    out: list[Tree] = []
    steps = iter([])
    split = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")

    def node(line: str, weight: float) -> Tree:
        if line.startswith("Predict: "):
            return weight * float(line[9:])
        found = split.fullmatch(line)
        if not found:
            raise ValueError(f"not a split by a threshold: {line}")
        low = node(next(steps), weight)
        next(steps)  # Else
        return int(found[2]), float(found[4]), low, node(next(steps), weight)

    for part in re.split(r"^\s*Tree \d+ ", text, flags=re.M)[1:]:
        head, *rest = [x.strip() for x in part.strip().splitlines()]
        steps = iter(rest)
        out.append(node(next(steps), float(re.fullmatch(r"\(weight (\S+)\):", head)[1])))
    return out


def leaves_of(tree: Tree, bounds: dict[int, tuple] | None = None) -> list[tuple[float, dict[int, tuple]]]:
    """(value, {feature: (above, up to)}) of every leaf that some row can reach; None is no bound."""
    bounds = bounds or {}
    if not isinstance(tree, tuple):
        return [(tree, bounds)]
    feature, threshold, low, high = tree
    above, most = bounds.get(feature, (None, None))
    out = []
    if above is None or threshold > above:
        out += leaves_of(low, bounds | {feature: (above, threshold if most is None else min(most, threshold))})
    if most is None or threshold < most:
        out += leaves_of(high, bounds | {feature: (threshold if above is None else max(above, threshold), most)})
    return out


def _fits(value: float, bound: tuple) -> bool:
    return (bound[0] is None or value > bound[0]) and (bound[1] is None or value <= bound[1])


def _leaf_table(value: float, bounds: dict[int, tuple], background: Sequence[tuple], n: int) -> list[list[float]]:
    """For each pattern of conditions a row fits: its n Shapley values from this leaf, then the leaf's output."""
    names, k = list(bounds), len(bounds)
    behind = Counter(tuple(_fits(row[f], bounds[f]) for f in names) for row in background)
    table = []
    for pattern in range(2**k):
        own = [bool(pattern >> (k - 1 - j) & 1) for j in range(k)]
        out = [0.0] * (n + 1)
        for other, count in behind.items():
            if not all(a or b for a, b in zip(own, other)):
                continue  # no coalition reaches the leaf
            gains = [f for f, a, b in zip(names, own, other) if a and not b]
            losses = [f for f, a, b in zip(names, own, other) if b and not a]
            u, v = len(gains), len(losses)
            share = value * count / len(background) / math.factorial(u + v)
            for f in gains:
                out[f] += share * math.factorial(u - 1) * math.factorial(v)
            for f in losses:
                out[f] -= share * math.factorial(u) * math.factorial(v - 1)
        out[n] = value if all(own) else 0.0
        table.append(out)
    return table


def tree_shapley_values(
    df: DataFrame, key: str, features: Sequence[str], background: Sequence[tuple], trees: Sequence[Tree], scale: float = 1.0
) -> DataFrame:
    """`shapley_values` of `scale` times the sum of the trees, one row in and one row out.

    Every leaf adds the entry of its table that belongs to the conditions a row
    fits. Tables have 2 ** conditions entries, so they suit shallow trees.
    """
    n = len(features)
    leaves = [(scale * v, b) for t in trees for v, b in leaves_of(t)]
    base = sum(v * sum(all(_fits(z[f], b) for f, b in bounds.items()) for z in background) for v, bounds in leaves)
    written = [
        {
            "c": [{"f": f + 1, "lo": lo, "hi": hi} for f, (lo, hi) in bounds.items()],
            "t": _leaf_table(v, bounds, background, n),
        }
        for v, bounds in leaves
    ]
    kind = "array<struct<c: array<struct<f: int, lo: double, hi: double>>, t: array<array<double>>>>"
    tables = df.sparkSession.createDataFrame([(json.dumps(written),)], "leaves string")
    tables = tables.select(F.from_json("leaves", kind).alias("leaves"))
    x = F.col("_x")

    def pattern(conditions: Column) -> Column:
        def fits(c: Column) -> Column:
            v = F.element_at(x, c["f"])
            return F.coalesce(v > c["lo"], F.lit(True)) & F.coalesce(v <= c["hi"], F.lit(True))

        return F.aggregate(conditions, F.lit(0), lambda acc, c: acc * 2 + fits(c).cast("int"))

    def add(acc: Column, leaf: Column) -> Column:
        return F.zip_with(acc, F.element_at(leaf["t"], pattern(leaf["c"]) + 1), lambda a, b: a + b)

    zeros = F.array(*[F.lit(0.0)] * (n + 1))
    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    summed = rows.withColumn("_leaves", tables.scalar()).select(key, F.aggregate("_leaves", zeros, add).alias("_v"))
    return summed.select(
        key,
        *[F.col("_v")[i].alias(f"phi_{c}") for i, c in enumerate(features)],
        F.lit(base / len(background)).alias("base_value"),
        F.col("_v")[n].alias("output"),
    )


def boosted_trees(model: PipelineModel) -> list[Tree]:
    """The trees of a fitted boosted classifier; twice their sum is the log-odds of class one."""
    return parse_trees(model.stages[-1].toDebugString)


def global_importance(values: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature."""
    row = values.agg(*[F.avg(F.abs(f"phi_{c}")).alias(c) for c in features])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs")) for c in features])
    return row.select(F.explode(items).alias("i")).select("i.*")


def example_per_class(values: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """The attributions of one row of each class, the one with the smallest key."""
    joined = values.join(labels.select(key, label), key)
    rest = [c for c in joined.columns if c not in (key, label)]
    first = F.min(F.struct(key, *rest)).alias("r")
    return joined.groupBy(label).agg(first).select(label, "r.*")


def model_margin(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """Score rows with the log-odds a fitted binary classifier gives class one."""

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        p = vector_to_array("probability")[1]
        return scored.withColumn("_p", p).withColumn("_score", F.log(F.col("_p") / (1.0 - F.col("_p"))))

    return score


def column_score(value: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("_score", value)


def linear_attribution(
    vectors: DataFrame, background: DataFrame, weights: list[list[float]], labels: Sequence, names: Sequence[str]
) -> DataFrame:
    """Mean |w * (x - mean)| per class and feature of a linear model; the mean is that of the background rows.

    Only stored entries of the sparse vectors are exploded. A row without a
    feature contributes |w * mean|, which needs no row at all.
    """
    spark = vectors.sparkSession

    def entries_of(df: DataFrame) -> DataFrame:
        return df.select(_entries(F.col("features")).alias("e")).select(F.explode("e").alias("e")).select("e.*")

    total = vectors.agg(F.count(F.lit(1)).cast("double")).scalar()
    behind = background.agg(F.count(F.lit(1)).cast("double")).scalar()
    means = entries_of(background).groupBy("i").agg((F.sum("x") / F.first(behind)).alias("mean"))
    seen = entries_of(vectors).groupBy("i", "x").agg(F.count(F.lit(1)).alias("c"))
    folded = (
        seen.join(means, "i", "full")
        .withColumn("mean", F.coalesce("mean", F.lit(0.0)))
        .groupBy("i")
        .agg(
            F.coalesce(F.sum(F.col("c") * F.abs(F.col("x") - F.col("mean"))), F.lit(0.0)).alias("present"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("rows"),
            F.first("mean").alias("mean"),
        )
        .withColumn("n", total)
    )
    spread = (F.col("present") + (F.col("n") - F.col("rows")) * F.abs("mean")) / F.col("n")
    # One weight per term and class: bounded by the vocabulary size of the model.
    table = spark.createDataFrame(
        [(i, names[i], str(labels[k]), float(row[i])) for k, row in enumerate(weights) for i in range(len(names))],
        "i int, feature string, class string, weight double",
    )
    return table.join(folded.select("i", spread.alias("spread")), "i").select(
        "class", "feature", "weight", (F.abs("weight") * F.col("spread")).alias("mean_abs")
    )


def _entries(v: Column) -> Column:
    """Stored entries of a sparse vector column as (i, x) structs.

    Read from the vector's text form "(size,[indices],[values])", which keeps
    the step inside the JVM.
    """
    text = v.cast("string")

    def numbers(group: int, kind: str) -> Column:
        inside = F.regexp_extract(text, r"^\(\d+,\[([^\]]*)\],\[([^\]]*)\]\)$", group)
        return F.transform(F.filter(F.split(inside, ","), lambda s: s != ""), lambda s: s.cast(kind))

    return F.zip_with(
        numbers(1, "int"), numbers(2, "double"), lambda i, x: F.struct(i.alias("i"), x.alias("x"))
    )


def top_terms(attributions: DataFrame, top: int = 15) -> DataFrame:
    """The terms with the largest attribution of every class."""
    best = Window.partitionBy("class").orderBy(F.col("mean_abs").desc(), "feature")
    return attributions.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)


def sample_to_explain(df: DataFrame, key: str, size: int) -> DataFrame:
    """A fixed-size sample in md5 order of the key, as attribution by expansion is costly."""
    order = F.md5(F.concat_ws("|", F.lit("explain"), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(size)

