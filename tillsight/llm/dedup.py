"""Exact duplicates: one 128-bit digest per row, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.sources.staging import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def exact_groups(docs: DataFrame, text: Column, id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, content_sha256.

    `text` is the normalised content (null is empty). Rows with the same bytes
    form a group; the row with the smallest (`keep="min"`) or largest id stays.

    Digests are counted first, on narrow rows. The content then travels once, to
    meet its digest's count, and is staged only where the digest repeats. There
    every row is compared, byte by byte, with the row that stays; a row that
    differs (a digest collision) is grouped by its full content instead, so no
    result rests on the digest alone. All joins have a unique right side: a
    group that holds a third of all rows can be split between tasks.

    Null ids lose against any id; a group without ids has a null keep_id. Rows
    that share content and id cannot be told apart: all of them count, and all
    report the same `kept`. Empty tables give empty results, other columns of
    any name are ignored.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text, F.lit("")).alias("_content")).select(
        "_id", "_content", F.unhex(F.md5("_content")).alias("_digest"), F.sha2("_content", 256).alias("_sha")
    )
    counts = rows.groupBy(F.col("_digest").alias("_d")).agg(F.count("*").alias("_n"), pick("_id").alias("_keep"))
    placed = materialize(
        rows.join(counts, F.col("_digest") == F.col("_d")).select(
            "_id", "_digest", "_sha", "_n", "_keep", F.when(F.col("_n") > 1, F.col("_content")).alias("_content")
        )
    )
    single = placed.where("_n = 1").select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("content_sha256"),
    )

    repeated = placed.where("_n > 1")
    stays = (
        repeated.where(F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy(F.col("_digest").alias("_d"))
        .agg(F.min("_content").alias("_first"))
    )
    compared = repeated.join(stays, F.col("_digest") == F.col("_d")).select(
        "_id", "_digest", "_sha", F.when(F.col("_content") != F.col("_first"), F.col("_content")).alias("_other")
    )
    sizes = compared.groupBy(F.col("_digest").alias("_d"), F.col("_other").alias("_o")).agg(
        F.count("*").alias("group_size"), pick("_id").alias("keep_id")
    )
    grouped = compared.join(
        sizes, (F.col("_digest") == F.col("_d")) & F.col("_other").eqNullSafe(F.col("_o"))
    ).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("content_sha256"),
    )
    return single.unionByName(grouped)
