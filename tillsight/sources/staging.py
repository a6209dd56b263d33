"""Staging tables in the folder all executors share."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session in local mode (one process, one disk) uses its
    own scratch folder; any other master is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    scratch = spark.sparkContext._jvm.java.lang.System.getProperty("java.io.tmpdir")
    return f"file:{scratch}/tillsight-{os.getuid()}"


#: Bytes of a batch that a staged step hands to Python, so that a worker holds few long texts at a time.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Removes the shuffle files of a query when it has ended; else they stay until the driver collects its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """A path for a table of this application in the shared folder, removed by `clear_staged`."""
    return f"{shared_folder(spark)}/tillsight-stage-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries that run inside."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write a reduced table once and read it back (as `schema`, if types of the same layout are wanted).

    Used where an operator reads its input several times or loops over it. The
    copy survives the loss of executors, cuts the lineage, and gives the
    optimizer real sizes to choose joins by. The step's shuffle files go at once.
    Staged folders are reclaimed with the shared checkpoint folder (see `clear_staged`).
    """
    spark = df.sparkSession
    path = new_folder(spark)
    with settings(spark, {BATCH_SETTING: BATCH_BYTES, CLEANUP_SETTING: "true"}):
        df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing will read any more; other tables are left alone."""
    spark = df.sparkSession
    own = f"/tillsight-stage-{spark.sparkContext.applicationId}/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> bool:
    """Remove all tables this application has staged; results read from them must be written by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/tillsight-stage-{spark.sparkContext.applicationId}"
    )
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
