"""PCA whitening of embeddings by products of Spark MLlib block matrices.

1. *Fixed point.* Each entry ``c`` becomes the integer ``x = floor(256 * c)``; vectors
   that are null or hold a null or non-finite entry are left out.
2. *Fit list.* Every distinct ``x`` vector once, in blocks of ``BLOCK`` rows. A task
   numbers its blocks by itself: every task has as many numbers as the fullest needs.
   Numbers without a block, and the end of a task's last block, are zero rows of the
   centred matrix, which add nothing.
3. *Scatter.* The centred rows are a BlockMatrix B. ``B' B``, its middle dimension split
   over all tasks, is the scatter matrix: one small square matrix, whose eigenvectors
   ``eigh`` finds on the driver. Sums are exact integers, added up by dimension.
4. *Projection.* ``B W``, with the eigenvectors over the roots of the eigenvalues as W,
   gives every distinct vector's whitened coordinates; rows meet them by their x vector.

``deviation`` is an exact integer, ``sum((n x - S)^2)``, null where a long cannot hold it.
``identity_error`` is measured on the whitened coordinates themselves: the largest entry
of their covariance over the fit list minus the identity.

Defined results: vectors of another length than most of the remaining rows (ties: the
longest) belong to no matrix and are left out, like empty ones; components without
variance (eigenvalue not above ``FLAT`` of the largest) have no whitened value and are
not returned, so n = 1 and constant vectors give an empty result; entries so large that
``256 * c`` is no long are kept at the largest long; repeated rows each get their rows;
null and repeated ids are kept as they are; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.frames import landed, landed_and_seen

BLOCK = 1024
COMPONENTS = 4
#: An eigenvalue at or below this share of the largest one is rounding, not variance.
FLAT = 1e-12
LONG = 2**63 - 1

BLOCKS = "part long, nth long, n int, xs binary, total array<string>"
WHITENED = "x array<long>, deviation long, whitened array<double>"


class Whitening(NamedTuple):
    """Counts, sums and the projection that whitens; at most a few square matrices of one vector's length."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    #: One column for each component: the unit eigenvector over the root of its eigenvalue.
    projection: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fixed_points(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows whose vector is whole."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256.0).cast("long"))
    return vectors.filter(whole).select("vec_id", x.alias("x"))


def _exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2**62:
        return x.sum(axis=0).tolist()
    return [sum(column) for column in x.T.tolist()]


def numbered(fit: DataFrame, dims: int) -> DataFrame:
    """The fit list in blocks: a task's number, the block's number there, its rows, their entries, and their sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        rest = np.empty((0, dims), dtype=np.int64)

        def block(x: np.ndarray) -> pa.RecordBatch:
            columns = [[part], [nth], [len(x)], [np.ascontiguousarray(x).tobytes()], [[str(s) for s in _exact_sums(x)]]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "nth", "n", "xs", "total"])

        for batch in batches:
            entries = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            rest = np.concatenate([rest, entries])
            while len(rest) >= BLOCK:
                yield block(rest[:BLOCK])
                rest, nth = rest[BLOCK:], nth + 1
        if len(rest):
            yield block(rest)

    return fit.select("x").mapInArrow(work, BLOCKS)


def _entries(xs: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(xs, np.int64).reshape(-1, dims)


def centred(blocks: DataFrame, count: int, mean: np.ndarray) -> BlockMatrix:
    """The centred fit list as a matrix of ``count`` row blocks."""

    def matrix(row) -> tuple[tuple[int, int], DenseMatrix]:
        dims = len(mean)
        values = np.zeros((BLOCK, dims))
        values[: row.n] = _entries(row.xs, dims) - mean
        return (row.block, 0), DenseMatrix(BLOCK, dims, values.ravel(order="F"))

    return BlockMatrix(blocks.select("block", "n", "xs").rdd.map(matrix), BLOCK, len(mean), count * BLOCK, len(mean))


def product(a: BlockMatrix, b: BlockMatrix, middle: int) -> BlockMatrix:
    """``a b`` with the middle dimension split over so many tasks; Python's own ``multiply`` always takes one."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, middle)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def fitted(blocks: DataFrame, rows: int, count: int) -> tuple[Whitening, BlockMatrix] | None:
    """The whitening of the fit list in ``blocks`` and its centred matrix; None if nothing varies."""
    totals = blocks.select(F.posexplode("total").alias("dim", "s")).groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(totals.collect())]  # one row for each dimension
    mean = np.array([s / rows for s in sums])
    matrix = centred(blocks, count, mean)
    tasks = blocks.rdd.getNumPartitions()
    scatter = product(matrix.transpose(), matrix, tasks).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * rows)
    values, vectors = np.linalg.eigh(covariance)
    falling = np.argsort(-values, kind="stable")
    values, vectors = values[falling], vectors[:, falling]
    kept = min(COMPONENTS, int((values > FLAT * max(values[0], 0)).sum()))
    if not kept or values[0] <= 0:
        return None
    return Whitening(rows, sums, values[:kept], vectors[:, :kept] / np.sqrt(values[:kept]), float(np.trace(covariance))), matrix


def projected(blocks: DataFrame, matrix: BlockMatrix, whitening: Whitening) -> DataFrame:
    """Every vector of the fit list once: ``x, deviation, whitened``."""
    spark = blocks.sparkSession
    dims, k = whitening.projection.shape
    weights = DenseMatrix(dims, k, whitening.projection.ravel(order="F"))
    local = BlockMatrix(spark.sparkContext.parallelize([((0, 0), weights)], 1), dims, k, dims, k)
    product_rows = matrix.multiply(local).blocks.map(lambda b: (b[0][0], bytearray(b[1].toArray().tobytes())))
    values = spark.createDataFrame(product_rows, "at long, whitened binary")
    n, sums = whitening.n, whitening.sums

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64())]
        for batch in batches:
            for xs, white in zip(batch.column(0), batch.column(1)):
                x = _entries(xs.as_py(), dims)
                y = np.frombuffer(white.as_py()).reshape(-1, k)[: len(x)]
                columns = [list(x), deviations(x, n, sums), list(y)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["x", "deviation", "whitened"])

    return blocks.join(values, F.col("block") == F.col("at")).select("xs", "whitened").mapInArrow(work, WHITENED)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n x - S)^2)`` of each row, exact."""
    widest = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    if widest * widest * max(1, x.shape[1]) < 2**62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [d if d <= LONG else None for d in exact]


def identity_error(fit: DataFrame, k: int) -> float:
    """Largest entry of the whitened covariance over the fit list minus the identity."""

    def moments(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n, first, second = n + len(y), first + y.sum(axis=0), second + y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k + k * k), pa.int32()), pa.array([n] * (k + k * k), pa.int64()), pa.array(np.concatenate([first, second.ravel()]))],
            names=["cell", "n", "s"],
        )

    cells = fit.select("whitened").mapInArrow(partial(moments, k=k), "cell int, n long, s double")
    found = sorted(cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())  # k + k * k rows
    n, s = found[0]["n"], np.array([r["s"] for r in found])
    mean = s[:k] / n
    covariance = s[k:].reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame) -> DataFrame:
    """One row for each remaining vector and component."""
    spark: SparkSession = vectors.sparkSession
    points = fixed_points(vectors)
    sizes = points.filter("size(x) > 0").groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    points = points.filter(F.size("x") == sizes["dims"])
    blocks, seen = landed_and_seen(
        numbered(points.select(F.xxhash64("x").alias("h"), "x").distinct(), sizes["dims"]),
        n=F.sum("n"), part=F.max("part"), nth=F.max("nth"),
    )
    if not seen["n"]:
        return spark.createDataFrame([], RESULT)
    each = seen["nth"] + 1
    blocks = blocks.select((F.col("part") * each + F.col("nth")).alias("block"), "n", "xs", "total")
    found = fitted(blocks, seen["n"], (seen["part"] + 1) * each)
    if found is None:
        return spark.createDataFrame([], RESULT)
    whitening, matrix = found
    fit = landed(projected(blocks, matrix, whitening))
    error = identity_error(fit, len(whitening.eigenvalues))
    explained = F.array(*(F.lit(float(e) / whitening.trace) for e in whitening.eigenvalues))
    # the hash comes first, so that sorting and meeting seldom compare whole vectors
    return (
        points.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("x").alias("h"), "x")
        .join(fit.select(F.xxhash64("x").alias("k"), F.col("x").alias("y"), "deviation", "whitened"), (F.col("h") == F.col("k")) & (F.col("x") == F.col("y")))
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(whitening.n).cast("long").alias("n"), "deviation",
            F.col("value").alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
