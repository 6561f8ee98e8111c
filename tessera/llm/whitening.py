"""Whitening of vectors by a tall and skinny QR factorisation.

Rows are centred by exact integer sums, every partition's rows are factored, and the R factors are
merged in a tree until one is left. Its singular values and right vectors are those of all centred
rows, so that they whiten these although a covariance is never formed. What a task holds is a batch
of rows and one R; what the driver gets is the last R, as large as the square of the vectors' length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import others, quoted, table
from tessera.llm.words import released
from tessera.session import dropped, written

#: Whole numbers to one of a vector's units; R factors that are merged at once; rows that are factored at once.
SCALE, FAN_IN, ROWS_AT_ONCE = 256, 16, 4096
COMPONENTS = 4
#: Singular values below this share of the largest are rounding, not directions.
LEAST_SHARE = 1e-11
FACTOR = "place long, r binary"


@dataclass
class Whitening:
    """n distinct rows with exact sums; directions (one a column), their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less their mean: the subtraction is exact where n times a row fits a long."""
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.eigenvalues)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n times each row, less the sums: as longs where these hold them, else as Python's numbers."""
    most = n * int(np.abs(x).max(initial=0).item() if len(x) else 0) + max(map(abs, sums), default=0)
    if most < 2**62 and not (x == np.iinfo(np.int64).min).any():
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _differences(x, n, sums).astype(np.float64) / n


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact squared length of every row's difference; null where it is beyond a long."""
    apart = _differences(x, n, sums)
    if apart.dtype == object or (len(apart) and float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] >= 2**62):
        return [k if (k := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in apart]
    return (apart * apart).sum(axis=1).tolist()


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def scaled(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """``df`` with x: floor(scale * c) of every component c, as longs; an input column x is replaced.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out, as are those of another
    length than most vectors have (the longer one, if two are as frequent). Entries beyond a long become the nearest one.
    """
    c = quoted(vector)
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & (F.size(c) > 0)
    known = df.where(F.coalesce(sound, F.lit(False)))
    width = known.groupBy(F.size(c).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = known.where(F.size(c) == (width.width if width else 0))
    return rows.select(*(quoted(n) for n in others(df, "x")), F.transform(c, lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, n, total) of a partition's rows, exact: the halves of the numbers are summed up apart."""
    n, total = 0, None
    for batch in _slices(batches):
        x = _rows(batch.column(0), len(batch.column(0)[0]))
        part = [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
        n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["pos", "n", "total"])


def _packed(place: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["place", "r"])


def _factor(n: int, sums: list[int]) -> Callable:
    """The R factor of a partition's centred rows, one for each partition that has rows."""

    @released
    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, len(sums)))
        for batch in _slices(batches):
            r = np.linalg.qr(np.vstack((r, _centred(_rows(batch.column(0), len(sums)), n, sums))), mode="r")
        if len(r):
            yield _packed(TaskContext.get().partitionId(), r)

    return factor


def _merge(width: int) -> Callable:
    """The R factor of FAN_IN R factors at most."""

    def merge(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(r).reshape(-1, width) for r in group["r"].to_pylist()]
        return pa.Table.from_batches([_packed(group["place"][0].as_py() // FAN_IN, np.linalg.qr(np.vstack(parts), mode="r"))])

    return merge


def _tree_merged(factors: DataFrame, width: int, partitions: int) -> np.ndarray:
    """The one R factor that a tree of merges leaves; FAN_IN factors meet in a task, whatever their number is."""
    while partitions > 1:
        factors = factors.groupBy(F.floor(F.col("place") / FAN_IN).alias("parent")).applyInArrow(_merge(width), FACTOR)
        partitions = math.ceil(partitions / FAN_IN)
    return np.frombuffer(factors.first()["r"]).reshape(-1, width)


def fit(df: DataFrame, vector: str = "embedding", components: int | None = None, scale: int = SCALE) -> Whitening | None:
    """The whitening of the distinct scaled vectors of ``df``: TSQR, then the SVD of the last R.

    Equal vectors count once, whatever their number. components: of the largest eigenvalues (default: all); those
    along which the vectors do not differ are left out, so that there may be fewer or none. None for a table without vectors.
    """
    return _fitted(fit_list(df, vector, scale), components)


def fit_list(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(x): each distinct scaled vector once, as a written table."""
    return written(scaled(df.select(quoted(vector)), vector, scale).select("x").distinct())


def _fitted(rows: DataFrame, components: int | None) -> Whitening | None:
    # a row for each place of a vector
    totals = rows.mapInArrow(_sums, "pos int, n long, total decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("pos").collect()
    if not totals:
        return None
    n, sums = totals[0].n, [int(t.total) for t in totals]
    factors = written(rows.mapInArrow(_factor(n, sums), FACTOR))
    r = _tree_merged(factors, len(sums), 1 + factors.agg(F.max("place")).first()[0])
    dropped(factors)
    _, singular, right = np.linalg.svd(r)
    eigenvalues = singular**2 / n
    kept = int((singular > LEAST_SHARE * singular[0]).sum()) if singular[0] > 0 else 0
    kept = kept if components is None else min(kept, components)
    return Whitening(n, sums, right[:kept].T.copy(), eigenvalues[:kept], float(eigenvalues.sum()))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``df`` with deviation (the exact squared length of n * x less the sums; null beyond a long) and whitened, a number for each component.

    Rows that ``scaled`` leaves out are left out; columns named x, deviation or whitened are replaced. The model, a
    vector for each component, is sent to the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<deviation: long, whitened: array<double>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        kind = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
        for column in batches:
            x = _rows(column, len(own.sums))
            yield pa.array([{"deviation": d, "whitened": w} for d, w in zip(_deviations(x, own.n, own.sums), own.whitened(x).tolist())], kind)

    kept = others(df, "x", "deviation", "whitened")
    rows = scaled(df, vector, scale).select(F.struct(*(quoted(c) for c in kept)).alias("row"), made("x").alias("made"))
    return rows.select(*(F.col("row")[c].alias(c) for c in kept), "made.deviation", "made.whitened")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.eigenvalues)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(k * k + k)
        for batch in _slices(batches):
            z = own.whitened(_rows(batch.column(0), len(own.sums)))
            total += np.concatenate(((z.T @ z).ravel(), z.sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["pos", "total"])

    sums = [r.total for r in rows.mapInArrow(products, "pos int, total double").groupBy("pos").agg(F.sum("total").alias("total")).orderBy("pos").collect()]
    mean = np.array(sums[k * k :]) / model.n
    covariance = np.array(sums[: k * k]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound vectors along the four components with the largest eigenvalues; a row for each vector and component."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = fit_list(vectors)
    model = _fitted(rows, COMPONENTS)
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], result)
    error = identity_error(rows, model)
    dropped(rows)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("pos") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("pos")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
