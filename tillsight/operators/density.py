"""Topics by density: as many as the vectors have dense regions, the rest outliers.

A vector with at least `min_points` rows within a similarity, its own included,
is dense. Dense vectors that are similar share a topic, as do those they lead
to; another vector goes with its most similar dense neighbour, or to no topic.

Neighbours are looked for in buckets of vectors on the same side of random
hyperplanes, in several independent tables; a bucket that holds too many
vectors is cut by further planes. Similarities inside a bucket are exact. A
bucket names at most `min_points` neighbours of each vector and a spanning
forest of its dense ones, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.operators import ranking
from tillsight.operators.components import components, forest
from tillsight.sources.staging import materialize

OUTLIER = -1
#: Vectors of a bucket, planes of a table, planes that cut a bucket which holds too many.
BUCKET_ROWS, PLANES, MORE_PLANES = 1024, 60, 4
DIGITS = 9  # of similarities


def unit_vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """node (the smallest key of equal vectors), n (their rows), v (the vector at length one).

    Vectors that are null, empty, zero or hold null or non-finite entries have no direction and are left out.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), _direction(embedding).alias("v")).where("v is not null")
    return rows.groupBy("v").agg(F.min("key").alias("node"), F.count("*").alias("n")).select("node", "n", "v")


def _direction(embedding: str) -> Column:
    """The vector at length one; null if it has no direction."""
    x = F.col(embedding).cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c))
    return F.when((length > 0) & (length < float("inf")), F.transform(x, lambda c: c / F.nullif(length, F.lit(0.0))))


def _codes(vectors: DataFrame, width: int, tables: int, seed: int) -> DataFrame:
    """node, table, code: the sides of the table's planes the vector lies on, first plane in the highest bit."""
    planes = np.random.default_rng(seed).standard_normal((width, tables * PLANES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sides = batch.column(1).flatten().to_numpy().reshape(-1, width) @ planes > 0
            codes = sides.reshape(-1, tables, PLANES) @ powers
            node = np.repeat(batch.column(0).to_numpy(), tables)
            table = np.tile(np.arange(tables), batch.num_rows)
            columns = [pa.array(node), pa.array(table, pa.int32()), pa.array(codes.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "table", "code"])

    return vectors.select("node", "v").mapInArrow(emit, "node long, table int, code long")


def _buckets(codes: DataFrame, rows: int) -> DataFrame:
    """node, table, bucket, depth: the shortest sides in common with at most BUCKET_ROWS vectors.

    Vectors on the same side of all planes of a table are dealt by a digest, anew in each table.
    """
    depth = max(0, rows // BUCKET_ROWS).bit_length()
    left, placed = codes, []
    while True:
        now = left.withColumn("bucket", F.shiftright("code", PLANES - depth)).withColumn("depth", F.lit(depth))
        full = materialize(
            now.groupBy("table", "bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > BUCKET_ROWS)
        )
        if full.isEmpty():
            return _united([*placed, now])
        if depth == PLANES:
            parts = F.ceil(F.col("rows") / BUCKET_ROWS)
            dealt = now.join(full, ["table", "bucket"], "left").withColumn(
                "bucket", F.when(parts > 1, F.xxhash64("bucket", F.pmod(F.xxhash64("node", "table"), parts))).otherwise(F.col("bucket"))
            )
            return _united([*placed, dealt.select(now.columns)])
        placed.append(now.join(full, ["table", "bucket"], "left_anti").select(now.columns))
        left = now.join(full, ["table", "bucket"], "left_semi").select(codes.columns)
        depth = min(PLANES, depth + MORE_PLANES)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("node", "table", "bucket", "depth")


BUCKET = ["table", "depth", "bucket"]


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, flags, vectors) of every bucket of rows sorted by bucket."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            vectors = batch.column(5).flatten().to_numpy().reshape(batch.num_rows, -1)
            now = [keys, batch.column(3).to_numpy(), batch.column(4).to_numpy(), vectors]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if held is None or not len(held[0]):
            continue
        ends = np.flatnonzero(np.any(held[0][1:] != held[0][:-1], axis=1)) + 1
        cuts = [0, *ends, len(held[0])] if batch is None else [0, *ends]
        for a, b in zip(cuts, cuts[1:]):
            yield held[1][a:b], held[2][a:b], held[3][a:b]
        held = None if batch is None else [x[cuts[-1] :] for x in held]


def _with_end(batches):
    yield from batches
    yield None


def _similar(vectors: np.ndarray, least: float) -> np.ndarray:
    """Similarities of a bucket's vectors, -2 where below the least and on the diagonal."""
    s = np.round(vectors @ vectors.T, DIGITS)
    np.fill_diagonal(s, -2)
    s[s < least] = -2
    return s


def density_topics(
    df: DataFrame,
    key: str,
    embedding: str,
    min_similarity: float,
    min_points: int = 10,
    tables: int = 16,
    seed: int = 42,
) -> DataFrame:
    """key, topic: from 0 by falling size, then smallest key; OUTLIER for vectors in no dense region.

    Similarity is that of directions (cosine), rounded to DIGITS places. Keys
    are whole numbers. Rows with vectors without a direction or of another
    length than most are outliers. The number of topics follows from the data.
    """
    whole = materialize(unit_vectors(df, key, embedding))
    lengths = whole.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), "width").first()
    outliers = df.select(key, F.lit(OUTLIER).alias("topic"))
    if common is None:
        return outliers
    width = common.width
    vectors = whole.where(F.size("v") == width)
    buckets = _buckets(materialize(_codes(vectors, width, tables, seed)), common.rows)
    filled = materialize(buckets.join(vectors, "node").select(*BUCKET, "node", "n", "v"))

    def in_buckets(rows: DataFrame, fn, schema: str) -> DataFrame:
        return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "node").mapInArrow(fn, schema)

    def name(batches):
        for nodes, _, v in _each_bucket(batches):
            s = _similar(v, min_similarity)
            best = np.argsort(-s, axis=1, kind="stable")[:, :min_points]
            i, j = np.repeat(np.arange(len(nodes)), best.shape[1]), best.reshape(-1)
            near = s[i, j] > -2
            i, j = i[near], j[near]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j]), pa.array(s[i, j])], ["node", "other", "s"])

    named = in_buckets(filled, name, "node long, other long, s double")
    pairs = materialize(named.groupBy("node", "other").agg(F.max("s").alias("s")))
    counts = vectors.select("node", "n")
    others = pairs.join(counts.withColumnsRenamed({"node": "other", "n": "m"}), "other")
    summed = others.groupBy("node").agg(F.sum("m").alias("m"))
    dense = materialize(
        counts.join(summed, "node", "left")
        .where(F.col("n") + F.coalesce("m", F.lit(0)) >= min_points)
        .select("node", F.lit(1).cast("long").alias("n"))
    )

    def connect(batches):
        for nodes, _, v in _each_bucket(batches):
            i, j = np.nonzero(np.triu(_similar(v, min_similarity) > -2))
            kept = forest(i, j)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i[kept]]), pa.array(nodes[j[kept]])], ["a", "b"])

    cores = filled.drop("n").join(dense, "node").select(*BUCKET, "node", "n", "v")
    labels = components(in_buckets(cores, connect, "a long, b long"))
    core = materialize(dense.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    # A vector that is not dense has fewer neighbours than a bucket names, so all of them are among the pairs.
    rest = pairs.join(core.withColumnsRenamed({"node": "other"}), "other").join(core.select("node"), "node", "left_anti")
    border = rest.groupBy("node").agg(F.min(F.struct((-F.col("s")).alias("s"), "other", "label")).alias("best"))
    placed = materialize(core.unionByName(border.select("node", F.col("best.label").alias("label"))))
    sizes = placed.join(counts, "node").groupBy("label").agg((-F.sum("n")).alias("less"), F.min("node").alias("first"))
    ranged = ranking.value_ranges(materialize(sizes), "less")
    numbers = ranking.number_rows(ranged, ["less", "first"]).select("label", (F.col("row_no") - 1).cast("int").alias("topic"))
    topics = placed.join(numbers, "label").join(vectors, "node").select("v", "topic")
    rows = df.select(F.col(key), _direction(embedding).alias("v"))
    return rows.join(topics, "v", "left").select(key, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))
