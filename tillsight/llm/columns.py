"""Operators that return the columns they are given keep them apart from their own by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns c0, c1, ... and the new name of each old one."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain, dict(zip(docs.columns, plain.columns))


def row_digest(docs: DataFrame) -> Column:
    """A digest of all columns; maps and variants, which have none, are left out."""
    plain = [F.col(f.name) for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")
