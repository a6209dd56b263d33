"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.sources.staging import discard, materialize

#: Edges a task holds while it looks for those that close a circle; so many are contracted in one task.
HELD_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of edges that connect what all edges connect, without circles."""
    return _contracted(a, b)[2]


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, the smallest node of each one's component, and the positions of edges that connect them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    left = np.flatnonzero(a != b)
    kept = []
    while len(left):
        x, y = label[a[left]], label[b[left]]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        kept.append(left[first])
        label[high] = np.minimum(x, y)[first]  # each joins a smaller one, so no circle arises
        while not np.array_equal(label[label], label):
            label = label[label]
        left = left[label[a[left]] != label[b[left]]]
    return nodes, nodes[label], np.concatenate(kept) if kept else np.empty(0, np.int64)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a graph of at most HELD_EDGES -> node, label."""
    a, b = (np.concatenate(x) for x in zip(*([c.to_numpy() for c in batch.columns] for batch in batches)))
    nodes, label, _ = _contracted(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])


def _without_circles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, less those that its earlier ones make superfluous."""

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    a = b = np.empty(0, np.int64)
    seen = 0
    for batch in batches:
        a, b = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((a, b)))
        if len(a) - seen >= HELD_EDGES:
            kept = forest(a, b)
            a, b, seen = a[kept], b[kept], len(kept)
            if seen > HELD_EDGES:
                yield out(a, b)
                a, b, seen = a[:0], b[:0], 0
    kept = forest(a, b)
    if len(kept):
        yield out(a[kept], b[kept])


def fewer_edges(edges: DataFrame) -> DataFrame:
    """At most one edge per node and task, with the same components."""
    known = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    return known.mapInArrow(_without_circles, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """`a, b` (longs) -> `node, label`: the smallest node of each node's component.

    Edges that close circles go inside tasks. While more than HELD_EDGES are
    left, a round hooks every node to the first of its neighbours in an order by
    a digest that is new in each round, and replaces edges by those between the
    nodes hooked to. A fixed share of the nodes goes in each round, whatever the
    shape; finished components leave at once. The last HELD_EDGES edges are
    contracted in one task. Loops, nulls and repeated edges do no harm.
    """
    now = materialize(fewer_edges(edges))
    hooks: list[DataFrame] = []
    while (left := now.count()) > HELD_EDGES:
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(hooks))).alias("d"), F.col(c).alias("n"))
        both = now.select("a", "b").union(now.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        hook = materialize(nearest.select(F.col("a").alias("node"), F.least("near", order("a"))["n"].alias("up")))
        one = now.join(hook.withColumnsRenamed({"node": "a", "up": "x"}), "a")
        two = one.join(hook.withColumnsRenamed({"node": "b", "up": "y"}), "b")
        after = materialize(fewer_edges(two.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        discard(now)
        now = after
        hooks.append(hook)
    last = now.coalesce(1).mapInArrow(_labelled, "node long, label long")
    found = materialize(last) if left else now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if not hooks:
        return found
    for hook in hooks[::-1]:
        later = found.select(F.col("node").alias("up"), "label")
        found = hook.join(later, "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    found = materialize(found)
    for hook in hooks:
        discard(hook)
    smallest = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(smallest, "label").select("node", F.col("least").alias("label"))
