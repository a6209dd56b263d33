"""Readers for the raw files and for stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.sources import schemas
from tillsight.sources.quoted import read_quoted_csv


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A/B-test snapshots from CSV; empty variances become NULL.

    Columns are matched by header name, so the order in the file is free.
    """
    names = [f.name for f in schemas.SNAPSHOTS]
    raw = spark.read.option("header", True).csv(path)
    # Counts and ids may be written as 3.0, so numbers pass through DOUBLE.
    return raw.select(
        *[
            F.col(f.name)
            if f.dataType.simpleString() == "string"
            else F.col(f.name).cast("double").cast(f.dataType).alias(f.name)
            for f in (schemas.SNAPSHOTS[n] for n in names)
        ]
    )


def read_transactions(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Order lines from CSV in a non-UTF-8 encoding, renamed and typed."""
    raw = (
        spark.read.schema(schemas.TRANSACTIONS_FILE)
        .option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return raw.withColumnsRenamed(schemas.TRANSACTION_HEADERS).withColumn("invoice_date", F.to_timestamp("invoice_date"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews from CSV with line breaks inside quotes, several tasks a file."""
    return read_quoted_csv(spark, path, schemas.REVIEWS)


def read_sql(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    """The result of a SQL statement over the given tables."""
    return spark.sql(statement, **views)


def jdbc_options(
    url: str, statement: str, split: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str
) -> dict[str, str]:
    """Options that read a statement's result; with a numeric column and its bounds in `parts` tasks."""
    out = {"url": url, "dbtable": f"({statement}) t", **options}
    if split is not None:
        if bounds is None or parts < 1:
            raise ValueError("a split column needs bounds and a number of parts")
        low, high = bounds
        out |= {"partitionColumn": split, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


def read_jdbc(spark: SparkSession, url: str, statement: str, **options) -> DataFrame:
    """The result of a statement run by a database (see jdbc_options)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, statement, **options)).load()


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    rows = [(t.name, bool(t.isTemporary)) for t in found]
    return spark.createDataFrame(rows, "table_name string, is_temporary boolean")


def peek(df: DataFrame, rows: int = 2) -> tuple[list[tuple[str, str]], DataFrame]:
    """Column types and the first rows."""
    return df.dtypes, df.limit(rows)
