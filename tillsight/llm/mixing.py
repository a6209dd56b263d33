"""Mixing sources to target weights by dependent rounding of copy numbers.

Every document of a source starts with the same real copy number, target words
over source words. Its whole part is certain; the fractions are rounded by
pivotal sampling: two documents meet, words of one are moved to the other at
random (without bias) until the copy number of one is whole, and the one left
with a fraction meets the next. Each meeting keeps the sum of words, so a
source misses its target by less than the last few documents' sizes.

Meetings run in a reduction tree: documents of one source and size class are
dealt over buckets by a digest of their id, each bucket leaves one document with
a fraction, and 64 buckets meet in one at the next level, down to one document
per source and size class. These last ones are rounded from the largest
to the smallest, each to the side that makes up for the words owed so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.columns import positional, row_digest
from tillsight.operators import ranking
from tillsight.sources.staging import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A source is read at most so many times.
MOST_COPIES = 3
#: Documents per bucket of the first level, and buckets that meet in one at the next.
BUCKET_ROWS, FAN_IN_BITS = 512, 6
UNIT = "id string, source string, size long, content long, k int, source_size long, target double, whole long, x double, u long, class int, bucket long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """`source, source_size` -> the same with `weight` and `target`.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the
    sum of all sizes by weight; what a share exceeds MOST_COPIES times its
    source's size by is shared again among the others until no share does.
    """
    ordered = [F.col("source").asc_nulls_last()]
    ranged = materialize(sizes.repartitionByRange(*ordered).withColumn("_b", F.spark_partition_id()))
    weighted = materialize(
        ranking.number_rows(ranged, ordered).select(
            "source", "source_size", ((F.col("row_no") - 1) % MOST_COPIES + 1).cast("long").alias("weight")
        )
    )
    most = F.col("source_size") * MOST_COPIES

    def over(left: int, weights: int) -> Column:
        exact = "decimal(38,0)"
        return F.col("weight").cast(exact) * F.lit(left).cast("decimal(19,0)") > most.cast("decimal(20,0)") * F.lit(
            weights
        ).cast("decimal(18,0)")

    total, weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weights, known = total or 0, weights or 1, -1
    while True:
        # Shares only grow from pass to pass, so a source once full stays full.
        full, n, free = weighted.agg(
            F.coalesce(F.sum(F.when(over(left, weights), most)), F.lit(0)),
            F.count_if(over(left, weights)),
            F.sum(F.when(~over(left, weights), F.col("weight"))),
        ).first()
        if n == known or not free:
            break
        known, left, weights = n, (total or 0) - full, free
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(weights))
    return weighted.withColumn("target", F.when(over(left, weights), most.cast("double")).otherwise(share))


def _mixed(h: int, g: int) -> float:
    """A number in [0, 1) from two digests."""
    x = (h ^ (g * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) / 2.0**64


def meet(size_a: int, a: float, size_b: int, b: float, draw: float) -> tuple[float, float]:
    """Move words between two fractions until one is 0 or 1; the expected values stay."""
    up, down = min(size_a * (1 - a), size_b * b), min(size_a * a, size_b * (1 - b))
    if draw * (up + down) < down:
        a_new = 1.0 if up == size_a * (1 - a) else a + up / size_a
        b_new = 0.0 if up == size_b * b else b - up / size_b
    else:
        a_new = 0.0 if down == size_a * a else a - down / size_a
        b_new = 1.0 if down == size_b * (1 - b) else b + down / size_b
    return a_new, b_new


def _is_open(x: float) -> bool:
    return 1e-9 < x < 1 - 1e-9


def meetings(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by `key`: all but the last open one of each group come out whole."""
    held, held_key = None, None
    names: list[str] = []
    for frame in frames:
        names = list(frame.columns)
        x_at, size_at, u_at = names.index("x"), names.index("size"), names.index("u")
        key_at = [names.index(c) for c in key]
        out = []
        for row in frame.itertuples(index=False, name=None):
            now = tuple(row[i] for i in key_at)
            row = list(row)
            if held is not None and now != held_key:
                out.append(held)
                held = None
            if held is None:
                held, held_key = row, now
                continue
            draw = _mixed(held[u_at], row[u_at])
            held[x_at], row[x_at] = meet(held[size_at], held[x_at], row[size_at], row[x_at], draw)
            if _is_open(row[x_at]):
                held, row = row, held
            out.append(row)
            if not _is_open(held[x_at]):
                out.append(held)
                held = None
        if out:
            yield pd.DataFrame(out, columns=names).astype(frame.dtypes.to_dict())
    if held is not None:
        yield pd.DataFrame([held], columns=names)


def _close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last open rows of each source, largest class first, rounded with the words owed carried on."""
    source, owed, first = None, 0.0, True
    for frame in frames:
        x = []
        for row in frame.itertuples(index=False):
            if first or row.source != source:
                source, owed, first = row.source, 0.0, False
            wanted = row.x * row.size + owed
            taken = 1.0 if 2 * wanted > row.size else 0.0
            owed = wanted - taken * row.size
            x.append(taken)
        yield frame.assign(x=x)


def round_copies(units: DataFrame) -> DataFrame:
    """Units with a fraction `x` in (0, 1) and a digest `u`: `x` becomes 0 or 1."""
    n = units.count()
    bits = max(0, (max(n, 1) // BUCKET_ROWS).bit_length())
    key = ["source", "class", "bucket"]
    settled = []
    while True:
        bucket = F.shiftrightunsigned("u", 64 - bits) if bits else F.lit(0).cast("long")
        dealt = (
            units.withColumn("bucket", bucket)
            .repartition(*key)
            .sortWithinPartitions(*key, "u", "id", "content", "k")
            .mapInPandas(lambda frames: meetings(frames, key), UNIT)
        )
        level = materialize(dealt)
        is_open = F.col("x").between(1e-9, 1 - 1e-9)
        settled.append(level.where(~is_open))
        units = level.where(is_open)
        if not bits:
            break
        bits = max(0, bits - FAN_IN_BITS)
    last = (
        units.repartition("source")
        .sortWithinPartitions("source", F.col("class").desc(), "u", "id", "content", "k")
        .mapInPandas(_close, UNIT)
    )
    for part in settled:
        last = last.unionByName(part)
    return last.withColumn("x", F.round("x"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0):
    """One row per document: id, source, size, content, k, source_size, target, copies.

    `size` is the number of words (null text: 0), `content` a digest of the row,
    `k` numbers rows with equal id, source, size and content, `copies` is 0 to
    MOST_COPIES. A document without words
    changes no source's sum and gets one copy. Null sources form a source of
    their own; null ids are ordinary. Reruns on the same rows give the same
    copies, however they are partitioned. Empty tables give empty results.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = (
        docs.select(
            F.col(id_col).cast("string").alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            row_digest(docs).alias("content"),
        )
        .groupBy("id", "source", "size", "content")
        .agg(F.count("*").cast("int").alias("n"))
    )
    rows = materialize(rows)
    targets = source_targets(
        rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    )
    share = F.col("target") / F.col("source_size")
    planned = (
        ranking.attach(rows.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))), targets, ["source"])
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(share)).otherwise(1).cast("long"))
        .withColumn("x", F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0))
        .withColumn("u", F.xxhash64("id", "content", "size", "k", F.lit(seed)))
        .withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
        .withColumn("bucket", F.lit(0).cast("long"))
        .select("id", "source", "size", "content", "k", "source_size", "target", "whole", "x", "u", "class", "bucket")
    )
    planned = materialize(planned)
    is_open = F.col("x").between(1e-9, 1 - 1e-9)
    rounded = round_copies(planned.where(is_open)).unionByName(
        planned.where(~is_open).withColumn("x", F.round("x"))
    )
    return rounded.select(
        F.col("id").cast(id_type).alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "content",
        "k",
        "source_size",
        "target",
        (F.col("whole") + F.col("x").cast("long")).alias("copies"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Documents as the mix takes them: each row as often as it has copies, all columns unchanged.

    Rows that are equal in all columns are taken together, as often as they have
    copies in all. Columns may have any names.
    """
    plain, at = positional(docs)
    i, t, s = at[id_col], at[text_col], at[source_col]
    key = [F.col(i).cast("string").alias("id"), F.col(s).alias("source"), word_count(F.col(t)).alias("size")]
    copies = mix(plain, i, t, s).select(F.col(i).cast("string").alias("id"), F.col(s).alias("source"), "size", "content", "copies")
    wanted = materialize(
        copies.groupBy("id", "source", "size", "content").agg(F.sum("copies").cast("int").alias("times"), F.count("*").alias("n"))
    ).toDF("_id", "_source", "_size", "_content", "_times", "_n")
    keyed = plain.select("*", F.struct(*key, row_digest(plain).alias("content")).alias("key"))
    same = (
        (F.col("key.content") == F.col("_content"))
        & (F.col("key.size") == F.col("_size"))
        & F.col("key.id").eqNullSafe(F.col("_id"))
        & F.col("key.source").eqNullSafe(F.col("_source"))
    )
    once = keyed.join(wanted.where("_n = 1 and _times > 0"), same)
    several = wanted.where("_n > 1 and _times > 0")
    taken = once if several.isEmpty() else once.unionByName(keyed.join(several, same).dropDuplicates(plain.columns))
    out = taken.select(*plain.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("copy"))
    return out.select(*plain.columns).toDF(*docs.columns)
