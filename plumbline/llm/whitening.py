"""Operator 13: embedding whitening by a two-pass covariance.

Entries become integers, so the first pass adds up exactly, in any order: rows, and each
dimension's sum. The second pass takes the mean off every vector and multiplies, one product of
matrices (GEMM) a batch; the tasks' sums meet in a tree (``treeAggregate``), so the driver adds a
few matrices whatever the number of tasks. Its symmetric eigenproblem is solved once (LAPACK),
and the projection, of dimensions x components numbers, goes out by broadcast. A third pass
over the whitened vectors measures their covariance, whose distance from the identity is reported.

What is held at once is a batch of vectors and matrices of dimensions x dimensions, whatever the
number of rows (``DIMENSIONS`` bounds them: 4,096 are 134 MB).

Defined cases: rows whose vector is null or holds null, NaN or infinite entries go; so do rows
whose vector has another length than most have (of equally frequent lengths the largest counts)
or none; an empty list gives no rows; repeated rows count each time; components of which the
variance is nothing but rounding are not given, so that equal vectors give no rows, and fewer
dimensions fewer components; entries are held within 2^62; a deviation of more than 38 digits is
null; the sign of a component makes its largest entry (the first of equals) positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import packed, unpacked

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
DIMENSIONS = 4096
#: Vectors that are multiplied at once.
BATCH = 4096
_LIMIT = 1 << 62


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows with vectors of finite entries and of the length that most of these have."""
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    some = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole)
    most = some.groupBy(F.size(vector).alias("_d")).agg(F.count("*").alias("_n")).agg(F.max_by("_d", F.struct("_n", "_d")).alias("_d"))
    d = most.first()["_d"] or 0
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {DIMENSIONS} are whitened")
    return some.filter(F.size(vector) == d)


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of integers from a list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * values)
    return (np.clip(x, -_LIMIT, _LIMIT).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for a in range(0, b.num_rows, BATCH):
            part = b.slice(a, BATCH)
            yield part, _integers(part.column(part.schema.get_field_index(vector)))


def _exact(x: np.ndarray, most: int, times: int) -> np.ndarray:
    """``x`` as it is where ``times`` numbers up to ``most`` add up within 64 bits, else as Python's
    integers, which have no end."""
    return x if most * times < _LIMIT else x.astype(object)


def _sums(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """The number of vectors and their exact sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _batches(batches, vector):
            s = _exact(x, int(np.abs(x).max()), len(x)).sum(0).astype(object)
            n, total = n + len(x), s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [[str(v) for v in total]]})

    parts = rows.select(vector).mapInArrow(run, "n long, s array<string>")
    by = parts.select("n", F.posexplode("s").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    return (by[0]["n"], [int(r["s"]) for r in by]) if by else (0, [])


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x - s exact, x - s / n)."""
    most = int(np.abs(x).max()) if x.size else 0
    d = _exact(x, most + SHIFT, n) * n - (s if most * n < _LIMIT and abs(max(s, key=abs)) < _LIMIT else s.astype(object))
    return d, d.astype(np.float64) / n


def _products(rows: DataFrame, vector: str, made: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of the outer products of what ``made`` makes of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _batches(batches, vector):
            z = made(x)
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = rows.select(vector).mapInArrow(run, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r["m"])).reshape(width, width))
    return parts.treeAggregate(np.zeros((width, width)), np.add, np.add, depth=3)


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns, those of which the variance is more
    than rounding."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    n = int(np.count_nonzero(values[:most] > len(values) * np.finfo(float).eps * max(values[0], 0)))
    values, vectors = values[:n], vectors[:, :n]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, np.arange(n)] < 0, -1.0, 1.0)


def whiten(df: DataFrame, vector: str = "vector", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``df`` and component: its columns, then component, n, deviation
    (decimal(38,0)), whitened, explained and identity_error; columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]
    names = [c for c in df.columns if c not in {f.name for f in made}]
    rows = packed(usable(df.select(*[F.col(f"`{c}`") for c in names]), vector), vector)
    n, total = _sums(rows, vector)
    held = T.StructType([*rows.schema, *made])
    if n == 0:
        return unpacked(df.sparkSession.createDataFrame([], held), names, *[f.name for f in made])
    s = np.array(total, dtype=np.int64 if max(map(abs, total)) < _LIMIT else object)
    covariance = _products(rows, vector, lambda x: _centred(x, n, s)[1], len(total)) / n
    values, axes = components(covariance, most)
    if not len(values):
        return unpacked(df.sparkSession.createDataFrame([], held), names, *[f.name for f in made])
    told = df.sparkSession.sparkContext.broadcast((axes / np.sqrt(values), values / np.trace(covariance)))
    seen = _products(rows, vector, lambda x: _centred(x, n, s)[1] @ told.value[0], len(values)) / n
    error = float(np.abs(seen - np.eye(len(values))).max())
    arrow = to_arrow_schema(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        projection, explained = told.value
        k, wide = len(explained), decimal.Context(prec=38)
        for part, x in _batches(batches, vector):
            d, c = _centred(x, n, s)
            square = _exact(d, int(np.abs(d).max()) ** 2, d.shape[1])
            deviation = [wide.create_decimal(v) if abs(v) < 10**38 else None for v in (square * square).sum(1).tolist()]
            again = np.repeat(np.arange(len(x)), k)
            new = {
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(again), n)),
                "deviation": pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(again)),
                "whitened": pa.array((c @ projection).reshape(-1)),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(len(again), error)),
            }
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(part.schema.get_field_index(f.name)).take(pa.array(again)) for f in arrow], schema=arrow)

    return unpacked(rows.mapInArrow(run, held), names, *[f.name for f in made])
