"""Embedding whitening (operator 13) with Spark MLlib's BlockMatrix.

Vectors become whole numbers, ``floor(256 * entry)``. The fit list holds each
distinct vector once: its rows, centred, are indexed into the blocks of a
BlockMatrix, whose transpose times itself is the scatter matrix; its
eigenvectors (a local ``eigh`` of width x width numbers) over the square roots
of their eigenvalues make the whitening matrix, and a BlockMatrix of all rows
times that matrix projects them.

Blocks are cut inside the tasks and kept as one row each, column after column,
so making them needs no shuffle and their places never change. The product of
the transpose splits its middle dimension, so no task meets more than
``BLOCKS_PER_TASK`` blocks of either side (a plain product of two matrices with
one block column would bring them all into one task). Per-dimension sums are
whole numbers throughout. MLlib lists the places of all blocks on the driver,
two numbers for every ``2 ** 20`` entries.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries
go; vectors shorter than the longest count as followed by zeros; entries beyond
the range of a long stop at its end; repeated vectors count once in the fit list
and have a row each in the result; a null key is carried through; a component
without variance is null in ``whitened`` and left out of ``identity_error``; a
``deviation`` beyond the range of a long is null; an empty table (or one whose
vectors have no entries) gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scoutmill.session import keep

#: Entries of a block: 8 MB of doubles.
BLOCK_ENTRIES = 1 << 20
BLOCKS_PER_TASK = 2
#: Eigenvalues below this share of the greatest are rounding, not variance.
NO_VARIANCE = 1e-13
LONG = 2**63

BLOCK_MATRIX = StructType([
    StructField("place", StructType([StructField("blockRowIndex", LongType()), StructField("blockColIndex", LongType())])),
    StructField("matrix", MatrixUDT())])


@dataclass
class Fit:
    """Numbers of the fit list: ``values`` fall, ``vectors`` has the components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, x) with x = floor(256 * entry) of the rows whose vector is whole, all as wide as the longest; and that width."""
    infinite = F.lit(float("inf"))
    usable = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    good = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    width = good.agg(F.max(F.size("v"))).first()[0] or 0
    x = F.concat(F.transform("v", lambda c: F.floor(c * 256)), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return good.select("key", x.alias("x")), width


class Blocks:
    """Vectors in blocks: a kept table of one row per block (part, number in it, keys, x column after column)."""

    def __init__(self, vectors: DataFrame, width: int):
        kind = vectors.schema["key"].dataType
        most = max(1, BLOCK_ENTRIES // width)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, held = TaskContext.get().partitionId(), 0, None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                while held.num_rows >= most:
                    yield block(part, number, held.slice(0, most))
                    held, number = held.slice(most), number + 1
            if held is not None and held.num_rows:
                yield block(part, number, held)

        def block(part: int, number: int, rows: pa.Table) -> pa.RecordBatch:
            keys = rows.column("key").combine_chunks()
            x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width).T.ravel()
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), whole(keys), whole(pa.array(x))], names=["part", "number", "keys", "x"])

        self.width, self.most, self.kind = width, most, kind
        self.table = keep(vectors.mapInArrow(cut, f"part int, number int, keys array<{kind.simpleString()}>, x array<long>"))
        self.starts, self.count = {}, 0
        for part, blocks in sorted(self.table.groupBy("part").agg(F.max("number") + 1).collect()):  # one row per task
            self.starts[part], self.count = self.count, self.count + blocks

    def each(self, columns: list[str], use, schema: str | StructType) -> DataFrame:
        """``use(block's place among all, row count x width numbers, the block's columns)`` gives Arrow batches."""
        starts, width = self.starts, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in columns}
                    x = batch.column("x")[i].values.to_numpy().reshape(width, -1).T
                    yield use(starts[batch.column("part")[i].as_py()] + batch.column("number")[i].as_py(), x, row)

        return self.table.select("part", "number", "x", *columns).mapInArrow(run, schema)

    def sums(self) -> tuple[int, list[int]]:
        """Rows, and the exact sum of each dimension (halves of the numbers are summed apart, so none wraps around)."""

        def add(_, x, __) -> pa.RecordBatch:
            columns = [np.arange(width), np.full(width, len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["dimension", "n", "high", "low"])

        width, wide = self.width, lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        rows = self.each([], add, "dimension long, n long, high long, low long").groupBy("dimension").agg(wide("n"), wide("high"), wide("low")).collect()
        rows.sort()
        return (int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]) if rows else (0, [])

    def centred(self, mean: np.ndarray) -> BlockMatrix:
        """Rows less the mean as a BlockMatrix; the last block of a task may hold fewer rows than its place has."""

        def matrix(place, x, _) -> pa.RecordBatch:
            values = pa.array((x - mean).ravel(order="F"))
            none, one = pa.array([None], pa.list_(pa.int32())), lambda v, kind: pa.array([v], kind)
            parts = [one(1, pa.int8()), one(len(x), pa.int32()), one(x.shape[1], pa.int32()), none, none, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), one(False, pa.bool_())]
            dense = pa.StructArray.from_arrays(parts, names=[f.name for f in MatrixUDT.sqlType().fields])
            at = pa.StructArray.from_arrays([one(place, pa.int64()), one(0, pa.int64())], names=["blockRowIndex", "blockColIndex"])
            return pa.RecordBatch.from_arrays([at, dense], names=["place", "matrix"])

        blocks = self.each([], matrix, BLOCK_MATRIX)
        return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, self.most, self.width, self.count * self.most, self.width), self.most, self.width)


def scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """Transpose times the matrix, the middle dimension dealt over ``blocks / BLOCKS_PER_TASK`` tasks."""
    model = lambda m: m._java_matrix_wrapper._java_model  # noqa: E731 - the product with splits has no Python method
    product = model(matrix.transpose()).multiply(model(matrix), max(1, blocks // BLOCKS_PER_TASK))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit(blocks: Blocks, components: int) -> Fit:
    """Components of the fit list, each with its largest entry above zero."""
    n, sums = blocks.sums()
    mean = np.array([s / n for s in sums])
    covariance = scatter(blocks.centred(mean), blocks.count) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Fit(n, sums, values, vectors * signs, float(np.trace(covariance)))


def whitening_matrix(fitted: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Columns that project on the components with unit variance (0 without variance), and which have variance."""
    varies = fitted.values > NO_VARIANCE * max(fitted.values.max(), 0.0)
    varies &= fitted.values > 0
    return np.where(varies, fitted.vectors / np.sqrt(np.where(varies, fitted.values, 1.0)), 0.0), varies


def identity_error(blocks: Blocks, fitted: Fit) -> float:
    """Largest absolute entry of the fit list's whitened covariance less the identity, measured on its rows."""
    matrix, varies = whitening_matrix(fitted)
    matrix, mean, k = matrix[:, varies], fitted.mean, int(varies.sum())
    if not k:
        return 0.0

    def moments(_, x, __) -> pa.RecordBatch:
        z = (x - mean) @ matrix
        values = np.r_[z.sum(0), (z.T @ z).ravel()]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    rows = sorted(blocks.each([], moments, "at long, value double").groupBy("at").agg(F.sum("value")).collect())
    values = np.array([r[1] for r in rows]) / fitted.n
    first, second = values[:k], values[k:].reshape(k, k)
    return float(np.abs(second - np.outer(first, first) - np.eye(k)).max())


def deviations(blocks: Blocks, fitted: Fit) -> DataFrame:
    """(index, key, deviation): the exact sum of (n * x - S) squared over the dimensions."""
    n, sums, most = fitted.n, fitted.sums, blocks.most
    key_type = blocks.table.schema["keys"].dataType.elementType

    def measure(place, x, row) -> pa.RecordBatch:
        top = n * max(-int(x.min()), int(x.max()), 0) + max(map(abs, sums))
        kind = np.int64 if top * top * len(sums) < LONG else object  # whole numbers of any size where longs would wrap
        total = ((x.astype(kind) * n - np.array(sums, dtype=kind)) ** 2).sum(1).tolist()
        index = place * most + np.arange(len(x))
        return pa.RecordBatch.from_arrays([pa.array(index), row["keys"].values, pa.array([t if t < LONG else None for t in total], pa.int64())], names=["index", "key", "deviation"])

    return blocks.each(["keys"], measure, StructType([StructField("index", LongType()), StructField("key", key_type), StructField("deviation", LongType())]))


def project(blocks: Blocks, fitted: Fit) -> DataFrame:
    """(index, scores): every row of ``blocks``, centred, times the whitening matrix."""
    matrix, _ = whitening_matrix(fitted)
    width, k = matrix.shape
    local = DenseMatrix(width, k, matrix.ravel(order="F").tolist())
    right = BlockMatrix(blocks.table.sparkSession.sparkContext.parallelize([((0, 0), local)], 1), width, k)
    product = blocks.centred(fitted.mean).multiply(right)
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("scores"))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    vectors, width = whole_vectors(rows, key, vector)
    if not width:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    every = Blocks(vectors, width)
    listed = Blocks(vectors.select("x").distinct().select(F.lit(None).cast("int").alias("key"), "x"), width)
    fitted = fit(listed, components)
    _, varies = whitening_matrix(fitted)
    explained = [float(v) / fitted.trace if fitted.trace > 0 else None for v in fitted.values]
    error = identity_error(listed, fitted)
    parts = F.array(*[F.struct(F.lit(j + 1).alias("component"), (F.col("scores")[j] if varies[j] else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[j]).cast("double").alias("explained")) for j in range(len(explained))])
    joined = deviations(every, fitted).join(project(every, fitted), "index").withColumn("c", F.explode(parts))
    return joined.select(F.col("key").alias(key), "c.component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
