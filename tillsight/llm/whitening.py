"""Whitening of embeddings by a spectral divide and conquer over polar decompositions.

Spark sums the vectors and the products of their centred entries; the
covariance (as many rows and columns as a vector has entries, whatever the
number of vectors) is taken apart on the driver: the polar factor of the
covariance minus a shift, by QR-based dynamically weighted Halley steps, is +1
on the eigenvectors above the shift and -1 on those below, so half of it plus
the identity is their projector. Bases of the two invariant subspaces are split
on until each holds a single component. The components go to all tasks, which
whiten the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.sources.staging import materialize

#: x = floor(SCALE * entry) + OFFSET; larger entries have no exact x.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**44
#: Components with a smaller share of the variance cannot be told from rounding and have no rows.
LEAST_SHARE = 2.0**-44

_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its eigenvectors with eigenvalues of +1 and -1."""
    n = len(a)
    x = a / np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf))
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # at most the smallest singular value
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, low) if low > _EPS / 8 else _EPS / 8
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        r = np.sqrt(1 + d)
        s = r + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * r))) / 2
        b = (s - 1) ** 2 / 4
        c = s + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        after = b / c * x + (s - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (s + b * low**2) / (1 + c * low**2))
        moved = np.linalg.norm(after - x)
        x = after
        if abs(1 - low) < 10 * _EPS and moved <= np.cbrt(5 * _EPS):
            break
    return x


def invariant_bases(a: np.ndarray, shift: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the eigenvectors above and below the shift."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if k in (0, n):
        return (np.eye(n)[:, :k], np.eye(n)[:, k:])
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(4):
        basis = projector @ np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
        full, _ = np.linalg.qr(basis, mode="complete")
        above, below = full[:, :k], full[:, k:]
        off = np.linalg.norm(below.T @ a @ above)
        if best is None or off < best[0]:
            best = off, above, below
        if off <= 10 * _EPS * np.linalg.norm(a):
            break
    return best[1], best[2]


def eigen(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    most = len(a) if most is None else most
    floor = _EPS * np.linalg.norm(a)
    values, vectors = [], []
    todo = [(a, np.eye(len(a)))]  # the parts with the larger eigenvalues come last
    while todo and len(values) < most:
        part, basis = todo.pop()
        centre = np.trace(part) / len(part)
        if len(part) == 1 or np.linalg.norm(part - centre * np.eye(len(part))) <= floor:
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        for shift in (float(np.median(np.diag(part))), centre):  # some eigenvalue lies on either side of the mean
            above, below = invariant_bases(part, shift)
            if above.shape[1] and below.shape[1]:
                break
        else:
            raise ArithmeticError("a covariance could not be split")
        for own in (below, above):
            small = own.T @ part @ own
            todo.append(((small + small.T) / 2, basis @ own))
    order = np.argsort(values, kind="stable")[::-1][:most]
    return np.array(values)[order], np.array(vectors)[order].T


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its entries are numbers of which x is exact."""
    column = F.col(vector) if isinstance(vector, str) else vector
    fits = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    return column.isNotNull() & F.coalesce(fits, F.lit(False))


def _x(column: pa.ListArray, width: int) -> np.ndarray:
    """The batch's x, a row for each vector."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, width) + OFFSET


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the rows i, v (array of `width` numbers) for each i."""
    sums = rows.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    return np.array([r.v for r in sums.orderBy("i").collect()])


def _products(rows: DataFrame, column: int, width: int, centred) -> np.ndarray:
    """Sum over all rows of the products of `centred(batch column)`'s entries, task by task and then in Spark."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = centred(batch.column(column))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], ["i", "v"])

    return _summed(rows.mapInArrow(emit, "i int, v array<double>"), width)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32
) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Left out are vectors that are null or hold null or non-finite entries,
    entries of 2**44 or more, whose x is not exact, vectors whose length is not
    the most frequent one (of several the longest; one without entries never),
    and components with a share of the variance of 2**-44 or less, of which
    rounding leaves nothing. All others fit the covariance. Null and repeated
    ids are passed on; other columns are not read. An empty table gives an empty
    result, and so do vectors that are all equal. A deviation beyond 64 bits is
    an error.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable("vector"))
    result = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).where("width > 0")
    common = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], result)
    width, n = common.width, common.n
    rows = rows.where(F.size("vector") == width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((_x(batch.column(1), width).sum(0) for batch in batches), np.zeros(width, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total])], ["i", "v"])

    s = _summed(rows.mapInArrow(sums, "i int, v array<long>"), width)[0].astype(np.int64)
    covariance = _products(rows, 1, width, lambda column: (n * _x(column, width) - s) / n) / n
    trace = float(np.trace(covariance))
    values, components = eigen((covariance + covariance.T) / 2, min(most, width))
    clear = values > LEAST_SHARE * trace
    values, components = values[clear], components[:, clear]
    k = len(values)
    if not k:
        return spark.createDataFrame([], result)
    scaled = components / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = n * _x(batch.column(1), width) - s
            safe = float(np.abs(apart).max(initial=0)) ** 2 * width < 2**62
            exact = apart if safe else apart.astype(object)
            white = apart / n @ scaled
            columns = [batch.column(0), pa.array([int(d) for d in (exact * exact).sum(1)], pa.int64()), pa.array(list(white))]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns, ["id", "deviation", "w"])

    white = materialize(rows.mapInArrow(project, f"id {id_type}, deviation long, w array<double>"))
    means = _summed(white.select(F.lit(0).alias("i"), F.col("w").alias("v")), k)[0] / n
    again = _products(
        white.select("w"), 0, k, lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - means
    )
    error = float(np.abs(again / n - np.eye(k)).max())
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return (
        white.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
        .withColumn("explained", shares[F.col("at")])
        .select(
            F.col("id").alias(id_col),
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            "explained",
            F.lit(error).alias("identity_error"),
        )
    )
