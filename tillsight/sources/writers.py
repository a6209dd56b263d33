"""Sinks: files, tables, databases, documents and models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header, replacing what was there."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet table; overwriting makes a reload repeatable."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


class RulesBroken(ValueError):
    """A version that its rules reject; `violations` counts the offending rows or keys per rule."""

    def __init__(self, violations: dict[str, int]):
        super().__init__(", ".join(f"{rule}: {n}" for rule, n in sorted(violations.items())))
        self.violations = violations


def publish_table(
    df: DataFrame, path: str, rules: Sequence[Callable[[DataFrame], DataFrame]] = (), keep: int = 1
) -> str:
    """Reload a table by write, audit, publish; returns the name of the new version.

    The rows are written to a version folder of their own. Each rule maps the
    written table to rows (rule, violations), as `quality.unique_key` and
    `quality.references` give them; where any is above zero, RulesBroken is
    raised. Only then does the table's pointer name the new version, by writing
    a pointer file and renaming it into place, so readers see the old table or
    the new one, whole, also if a reload fails half-way. The `keep` newest
    versions before it stay readable; older and rejected ones are removed.
    One writer at a time.
    """
    spark, version = df.sparkSession, f"v{uuid.uuid4().hex}"
    files = _Folder(spark, path)
    df.write.parquet(files.at(version))
    written = spark.read.schema(df.schema).parquet(files.at(version))
    if rules:
        found = reduce(DataFrame.unionByName, [rule(written) for rule in rules]).where("violations > 0").collect()
        if found:
            files.delete(version)
            raise RulesBroken({r.rule: r.violations for r in found})
    published = _published(spark, files)
    order = f"{int(published[-1].split('-')[0]) + 1 if published else 0:012d}"
    files.publish(f"{order}-{version}")
    for old in [*published, f"{order}-{version}"][: -1 - keep]:
        files.delete(f"current/{old}")
        files.delete(old.split("-")[1])
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that `publish_table` published last."""
    files = _Folder(spark, path)
    published = _published(spark, files)
    if not published:
        raise FileNotFoundError(f"nothing published in {path}")
    return spark.read.parquet(files.at(published[-1].split("-")[1]))


def _published(spark: SparkSession, files: _Folder) -> list[str]:
    """Pointers, oldest first; the last one counts."""
    return sorted(name for name in files.names("current") if not name.startswith((".", "_")))


class _Folder:
    """Files below a path of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.base = path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.base}/{name}"

    def names(self, name: str) -> list[str]:
        folder = self._path(self.at(name))
        return [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def publish(self, pointer: str) -> None:
        self._fs.mkdirs(self._path(self.at("current")))
        hidden = self._path(self.at(f"current/.{pointer}"))
        self._fs.create(hidden, True).close()
        if not self._fs.rename(hidden, self._path(self.at(f"current/{pointer}"))):
            raise OSError(f"pointer {pointer} was not renamed")


def jdbc_append_options(url: str, table: str, batch: int = 1000, **options: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, "batchsize": str(batch), **options}


def append_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    """Append to a database table, in batches of `batch` rows (see jdbc_append_options)."""
    df.write.mode("append").format("jdbc").options(**jdbc_append_options(url, table, **options)).save()


def write_documents(documents: DataFrame, path: str, form: str = "json") -> None:
    """One nested record per review, as JSON lines or Parquet."""
    documents.write.mode("overwrite").format(form).save(path)


def write_bridges(sentiment: DataFrame, aspects: DataFrame, keywords: DataFrame, folder: str) -> None:
    """The three bridge tables of the relational form."""
    tables = {"review_sentiment": sentiment, "review_aspects": aspects, "review_keywords": keywords}
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_parameters(spark: SparkSession, parameters: dict[str, float], path: str) -> None:
    """Fitted parameters as a one-row table."""
    names = sorted(parameters)
    schema = ", ".join(f"{n} double" for n in names)
    spark.createDataFrame([tuple(float(parameters[n]) for n in names)], schema).write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, float]:
    return spark.read.parquet(path).first().asDict()
