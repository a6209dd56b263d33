"""Boosted regression trees for several labels at once, over sparse features.

Spark ML boosts one label at a time and turns every row into a full array of
bins, so a step visits rows times features. Here a step is one job for all
labels: tasks add up gradients over the entries that rows hold, an entry that is
missing (zero) follows from the totals, and tasks by feature choose the splits.
Loss, step size, bins, depth and impurity are those of Spark's `GBTClassifier`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.sources.staging import CLEANUP_SETTING, discard, materialize, settings

STEP = 0.1
BINS = 32
#: Rows that a task adds up together, and rows that are worth a task of their own.
ROWS_AT_ONCE, ROWS_PER_TASK = 20_000, 2_500

# A tree lists its nodes by level: node i has children 2i+1 and 2i+2. A node is
# [feature, bin, threshold, value]; feature -1 marks a leaf, and values are means of the gradient.


def bin_edges(entries: DataFrame, size: int, bins: int = BINS) -> np.ndarray:
    """Upper edges of the bins of each feature's values; zero has a bin of its own, which is the first."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    found = (
        entries.select(F.explode(F.arrays_zip("indices", "values")).alias("e"))
        .where(F.col("e.values") != 0)
        .groupBy(F.col("e.indices").alias("feature"))
        .agg(F.percentile_approx("e.values", shares, 1000).alias("cuts"))
    )
    edges = np.full((size, bins - 2), np.inf)
    for r in found.collect():  # one short row a feature
        cuts = np.unique(r.cuts)
        edges[r.feature, : len(cuts)] = cuts
    return edges


def coded(entries: DataFrame, edges: np.ndarray, bins: int = BINS) -> DataFrame:
    """label and codes (feature * bins + bin) of the entries of every row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, values = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            order = np.argsort(features, kind="stable")
            place = np.empty(len(features), np.int32)
            starts = np.flatnonzero(np.diff(features[order], prepend=-1))
            for a, b in pairwise([*starts, len(order)]):
                at = order[a:b]
                f = features[at[0]]
                place[at] = f * bins + 1 + np.searchsorted(edges[f], values[at], side="left")
            place[values == 0] = -1
            codes = pa.ListArray.from_arrays(batch.column(1).offsets, pa.array(place))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], ["label", "codes"])

    return entries.select("label", "indices", "values").mapInArrow(code, "label int, codes array<int>")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, numbers of entries and codes of the entries, of about ROWS_AT_ONCE rows at a time."""
    parts, held = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            parts.append(_entries(part.column(0), part.column(1)))
            held += part.num_rows
            if held >= ROWS_AT_ONCE:
                yield tuple(np.concatenate(x) for x in zip(*parts))
                parts, held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _entries(labels: pa.Array, codes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths, code = codes.value_lengths().to_numpy(), codes.flatten().to_numpy()
    if len(code) and code.min() < 0:  # entries that are zero
        held = code >= 0
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[held], minlength=len(lengths))
        code = code[held]
    return labels.to_numpy(zero_copy_only=False), lengths, code


def leaf_places(tree: list, binned: np.ndarray, column: dict[int, int]) -> np.ndarray:
    """The node of a tree that each row ends in; `binned` has a line for each feature."""
    at = np.zeros(binned.shape[1], np.uint8 if len(tree) < 256 else np.int64)
    for i, (feature, cut, *_) in enumerate(tree):
        if feature >= 0:
            right = binned[column[feature]] > cut
            at += (at == i) * (right + at.dtype.type(i + 1))  # to 2i+1 or 2i+2
    return at


def _binned(lengths: np.ndarray, code: np.ndarray, features: list[int], size: int, bins: int):
    """Bins of the named features, a line for each, and their places."""
    column = {f: i for i, f in enumerate(features)}
    out = np.zeros((len(features), len(lengths)), np.uint8)
    if features:
        places = np.full(size, -1)
        places[features] = np.arange(len(features))
        at = places[code // bins]
        held = np.flatnonzero(at >= 0)
        out[at[held], np.repeat(np.arange(len(lengths)), lengths)[held]] = code[held] % bins
    return out, column


def _features(trees) -> list[int]:
    return sorted({n[0] for t in trees for n in t if n[0] >= 0})


def best_splits(rows: DataFrame, done: list, growing: list, level: int, size: int, bins: int, chunks: int) -> list:
    """For every label and node of the level: gain, feature, bin and the two sides' sums and counts.

    `done` has the finished trees of each label, `growing` the tree of each label as far as it has
    grown. Tasks send sums by feature, bin, node and label, whatever rows they read.
    """
    n_labels, first, n_nodes = len(growing), 2**level - 1, 2**level
    cells = size * bins
    width = -(-size // chunks) * bins
    used = _features([t for trees in (*done, growing) for t in trees])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n_labels, cells * n_nodes))
        totals = np.zeros((2, n_labels, n_nodes))
        for labels, lengths, code in _rows_of(batches):
            binned, column = _binned(lengths, code, used, size, bins)
            # Cells by code, then node: entries of a row come in the order of their codes.
            base = code.astype(np.int64) * n_nodes
            rows_held = np.bincount(base, minlength=cells) if not level else None
            for k in range(n_labels):
                margin = np.zeros(len(labels))
                for i, tree in enumerate(done[k]):
                    values = (STEP if i else 1.0) * np.array([n[3] for n in tree])
                    margin += values[leaf_places(tree, binned, column)]
                y = np.where(labels == k, 1.0, -1.0)
                target = 4.0 * y / (1.0 + np.exp(2.0 * y * margin)) if done[k] else y
                node = leaf_places(growing[k], binned, column).astype(np.int64) - first if level else np.zeros(len(labels), np.int64)
                live = node >= 0
                cell, weight = base + np.repeat(node, lengths) if level else base, np.repeat(target, lengths)
                if not live.all():
                    here = np.repeat(live, lengths)
                    cell, weight, node, target = cell[here], weight[here], node[live], target[live]
                sums[0, k] += np.bincount(cell, minlength=cells * n_nodes) if level else rows_held
                sums[1, k] += np.bincount(cell, weight, cells * n_nodes)
                totals[0, k] += np.bincount(node, minlength=n_nodes)
                totals[1, k] += np.bincount(node, target, n_nodes)
        if totals.any():
            parts = [sums[..., c * width * n_nodes : (c + 1) * width * n_nodes] for c in range(chunks)]
            blobs = [np.concatenate([p.ravel(), totals.ravel()]).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "sums"])

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        added = sum(np.frombuffer(blob) for blob in part["sums"])
        cut = len(added) - 2 * n_labels * n_nodes
        totals = added[cut:].reshape(2, n_labels, n_nodes)
        held = np.moveaxis(added[:cut].reshape(2, n_labels, -1, bins, n_nodes), -1, 2)
        held[..., 0] = totals[..., None] - held.sum(-1)  # rows without the feature
        low = np.cumsum(held, -1)[..., :-1]
        high = totals[..., None, None] - low
        fits = (low[0] > 0.5) & (high[0] > 0.5)
        parent = totals[1] ** 2 / np.maximum(totals[0], 1.0)
        score = low[1] ** 2 / np.maximum(low[0], 1.0) + high[1] ** 2 / np.maximum(high[0], 1.0)
        # Rounded: sums that differ by their order only must not tell splits apart.
        gain = np.where(fits, score - parent[..., None, None], -np.inf).round(9).reshape(n_labels, n_nodes, -1)
        at = gain.argmax(-1)
        out = []
        for k in range(n_labels):
            for n in range(n_nodes):
                f, b = divmod(int(at[k, n]), bins - 1)
                sides = [low[0, k, n, f, b], low[1, k, n, f, b], high[0, k, n, f, b], high[1, k, n, f, b]]
                out.append([k, n, gain[k, n, at[k, n]], key[0] * (width // bins) + f, b, *map(float, sides)])
        return pd.DataFrame(out, columns=names)

    names = ["label", "node", "gain", "feature", "bin", "n_low", "s_low", "n_high", "s_high"]
    shape = "label int, node int, gain double, feature int, bin int, n_low double, s_low double, n_high double, s_high double"
    best = {}
    with settings(rows.sparkSession, {CLEANUP_SETTING: "true"}):  # holds for what is planned inside
        sums = rows.mapInArrow(add, "chunk int, sums binary")
        found = sums.repartition(chunks, "chunk").groupBy("chunk").applyInPandas(choose, shape)
        splits = found.collect()  # one row for each label, node and chunk of features
    for r in splits:
        at = (r.label, r.node)
        if at not in best or (-r.gain, r.feature, r.bin) < (-best[at].gain, best[at].feature, best[at].bin):
            best[at] = r
    return [best[k] for k in sorted(best)]


def fit_trees(rows: DataFrame, labels: int, edges: np.ndarray, rounds: int, depth: int, bins: int = BINS) -> list[list]:
    """The trees of each label against the rest, from coded rows."""
    size = len(edges)
    chunks = min(size, 3 * rows.sparkSession.sparkContext.defaultParallelism)
    chunks = -(-size // -(-size // chunks))  # none without features
    done: list[list] = [[] for _ in range(labels)]
    for _ in range(rounds):
        growing = [[[-1, 0, 0.0, 0.0]] for _ in range(labels)]
        for level in range(depth):
            splits = best_splits(rows, done, growing, level, size, bins, chunks)
            for tree in growing:
                tree += [[-1, 0, 0.0, 0.0] for _ in range(2 ** (level + 1))]
            for s in splits:
                if s.gain > 1e-9:
                    tree, at = growing[s.label], 2**level - 1 + s.node
                    edge = 0.0 if s.bin == 0 else float(edges[s.feature, s.bin - 1])
                    tree[at][:3] = [s.feature, s.bin, edge]
                    tree[2 * at + 1][3], tree[2 * at + 2][3] = s.s_low / s.n_low, s.s_high / s.n_high
                elif not level:  # no split at all: the mean of all rows
                    growing[s.label][0][3] = (s.s_low + s.s_high) / max(s.n_low + s.n_high, 1.0)
        for k in range(labels):
            done[k].append(growing[k])
    return done


class BoostedLabels(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction`, the label whose trees give the largest margin."""

    trees = Param(Params._dummy(), "trees", "trees of each label as JSON", typeConverter=TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, trees: str = "[]", featuresCol: str = "features"):  # noqa: N803
        super().__init__()
        self._setDefault(trees="[]", featuresCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        grown = json.loads(self.getOrDefault("trees"))

        @F.udf("double")
        def label(vector) -> float:
            indices = vector.indices if hasattr(vector, "indices") else range(len(vector))
            x = dict(zip(map(int, indices), map(float, vector.values)))
            margins = []
            for trees in grown:
                margin = 0.0
                for i, tree in enumerate(trees):
                    at = 0
                    while tree[at][0] >= 0:
                        at = 2 * at + 1 + (x.get(tree[at][0], 0.0) > tree[at][2])
                    margin += (STEP if i else 1.0) * tree[at][3]
                margins.append(margin)
            return float(max(range(len(margins)), key=margins.__getitem__))

        return dataset.withColumn("prediction", label(self.getOrDefault("featuresCol")))


def fit_boosted_labels(features: DataFrame, label: str, labels: int, rounds: int, depth: int) -> BoostedLabels:
    """Trees for `labels` labels numbered from 0, each against the rest; `features` are vectors without negative entries."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, indices, values = (pc.struct_field(batch.column(1), c) for c in ("size", "indices", "values"))
            if indices.null_count:  # vectors that are not sparse
                every = [list(range(len(v))) if i is None else i for i, v in zip(indices.to_pylist(), values.to_pylist())]
                indices = pa.array(every, indices.type)
                size = pc.coalesce(size, pc.list_value_length(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), size, indices, values], ["label", "size", "indices", "values"])

    spark = features.sparkSession
    held = features.select(F.col(label).cast("int").alias("label"), "features")
    staged = materialize(held.mapInArrow(entries, "label int, size int, indices array<int>, values array<double>"))
    size, n = staged.agg(F.max("size"), F.count(F.lit(1))).first()
    edges = bin_edges(staged, size)
    # A task sends sums of a fixed size, so there are no more of them than run at once.
    tasks = min(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    rows = materialize(coded(staged, edges).repartition(4 * tasks)).coalesce(tasks)
    discard(staged)
    return BoostedLabels(trees=json.dumps(fit_trees(rows, labels, edges, rounds, depth)))
