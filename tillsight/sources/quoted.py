"""CSV files with line breaks inside quotes, read by several tasks a file.

Whether a line break ends a record depends on the quotes before it, so Spark
reads such a file in one task. Here a first pass only counts quotes per byte
range of a file; the running sum of the counts tells for each range whether it
starts inside quotes. In a second pass each task cuts its lines into records
from the first true start of a record on. Records that lie across ranges are
put together from their pieces, at most two for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECES = "file string, block long, crlf boolean, header boolean, starts boolean, ends boolean, text string"


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value (a line), file and block (where the byte range starts that the line starts in)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def quote_state(lines: DataFrame, quote: str = '"') -> DataFrame:
    """file, block, inside (whether the range starts inside quotes), open (whether the whole file ends inside), crlf.

    `crlf` tells whether the file's first line ends with CR LF; a range is read
    by one task from its start on.
    """
    n: Column = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    ranges = lines.groupBy("file", "block").agg(F.sum(n).alias("n"), F.first(F.endswith("value", F.lit("\r"))).alias("cr"))
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(
        "file",
        "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("n").over(whole) % 2 == 1).alias("open"),
        F.max(F.col("cr") & (F.col("block") == 0)).over(whole).alias("crlf"),
    )


def _cutter(ranges: dict[tuple[str, int], tuple[bool, bool]], quote: str):
    """Lines of a task -> records, and the pieces of those that lie across ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, crlf, header, starts, is_open = None, False, False, True, False
        held: list[str] = []
        out: list[tuple] = []

        def close(ends: bool) -> None:
            out.append((*now, crlf, header, starts, ends, "\n".join(held)))
            held.clear()

        def drain() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out)]
            out.clear()
            kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4, pa.string()]
            names = ["file", "block", "crlf", "header", "starts", "ends", "text"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for line, *place in zip(*(c.to_pylist() for c in batch.columns)):
                if place != now:
                    if held:
                        close(ends=False)
                    now = place
                    if tuple(now) not in ranges:
                        raise RuntimeError(
                            "the byte ranges of the files changed between two passes; set spark.sql.files.minPartitionNum"
                        )
                    is_open, crlf = ranges[tuple(now)]
                    starts, header = not is_open, now[1] == 0 and not is_open
                held.append(line)
                is_open ^= line.count(quote) % 2 == 1
                if not is_open:
                    close(ends=True)
                    starts, header = True, False
            if out:
                yield drain()
        if held:
            close(ends=False)
        if out:
            yield drain()

    return cut


def records(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """header (whether it is its file's first), text without its line end: one row per record.

    The driver holds two flags for each byte range, as it does the range itself.
    """
    lines = lines_of(spark, path)
    ranges = {}
    for r in quote_state(lines, quote).collect():
        if r.open:
            raise ValueError(f"{r.file} ends inside quotes")
        ranges[(r.file, r.block)] = r.inside, r.crlf
    pieces = lines.mapInArrow(_cutter(ranges, quote), PIECES)
    text = F.regexp_replace(F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text")), "\r$", "")
    if not any(inside for inside, _ in ranges.values()):
        return pieces.select("header", text.alias("text"))
    # A range has at most one piece that ends a record of an earlier one and one whose end is to come.
    order = Window.partitionBy("file").orderBy("block", "starts")
    parts = pieces.where("not (starts and ends)").withColumn("number", F.sum(F.col("starts").cast("int")).over(order))
    joined = parts.groupBy("file", "number").agg(
        F.max("header").alias("header"),
        F.max("crlf").alias("crlf"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n"
        ).alias("text"),
    )
    columns = ["crlf", "header", "text"]
    whole = pieces.where("starts and ends").select(columns).unionByName(joined.select(columns))
    return whole.select("header", text.alias("text"))


def read_quoted_csv(
    spark: SparkSession, path: str | list[str], schema: StructType, header: bool = True, quote: str = '"'
) -> DataFrame:
    """Rows of UTF-8 CSV files in which quotes stand around fields and are doubled inside them.

    Lines end with LF or CR LF. Line breaks inside quotes stay as they are, but
    CR LF becomes LF there too in files whose first line ends with CR LF.
    Empty lines between records are skipped, as is each file's first record if
    it is a header. A file that ends inside quotes is an error. Records that do
    not fit the schema become nulls, as in Spark's own reader.
    """
    found = records(spark, path, quote)
    if header:
        found = found.where("not header")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    options = {"quote": quote, "escape": quote, "multiLine": "true"}
    return found.where("text <> ''").select(F.from_csv("text", kinds, options).alias("row")).select("row.*")
