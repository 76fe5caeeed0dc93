"""Embedding whitening with distributed block matrices.

Vectors are put on an integer grid (x = floor(64 c) + 1000000). The fit list is each distinct x once; its centred rows are
indexed into the blocks of an MLlib ``BlockMatrix`` F, whose transpose times F is the scatter. Its eigenvectors are found
on the driver (dimension x dimension numbers), and a second ``BlockMatrix`` product, of the centred rows of all vectors
with the whitening matrix, projects them.

Rows are centred exactly before they are rounded: with S = q n + r per dimension, x - S/n is (x - q) - r/n. Blocks are
filled up with rows of zeros, which change neither a scatter nor another row.

Scale: the distinct vectors are found by one shuffle with partial aggregation, so a vector that a third of all rows
have is sent once per task. The scatter is summed per block of rows (one middle split per block, never all rows in one
task). MLlib keeps the list of block numbers on the driver; the rows of a block grow with the root of the table, so that
both a block's size and the number of blocks do (about 320 MB and 600,000 at 100 TB). The projection moves each block once and
meets its ids by block number. Everything is read again from written tables when an executor is lost.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped, as are those of another
length than the kept vector of the smallest id; floor(64 c) beyond +-2**30 counts as that bound; repeated rows are projected
each and fitted once; components are numbered by falling eigenvalue, and those whose eigenvalue is zero to rounding are left
out, so that equal vectors only give no rows, like an empty table; an eigenvector's largest entry is positive; a
deviation beyond a long is null; input columns named like an output column are replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C, vectors as V

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
LIMIT = 1 << 30
#: Values of a block at least.
BLOCK_VALUES = 1 << 18


def grid(matrix: np.ndarray) -> np.ndarray:
    """x - SHIFT."""
    return np.clip(np.floor(matrix * SCALE), -LIMIT, LIMIT).astype(np.int32)


def packed(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(i, x): id and packed grid vector of every kept row."""
    def run(batches):
        for batch in batches:
            for rows, matrix in V.matrices(batch, "v", dims):
                x = grid(matrix)
                offsets = np.arange(len(x) + 1, dtype=np.int64) * (4 * dims)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)),
                     pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])
                     .cast(pa.binary())], names=["i", "x"])

    schema = T.StructType([T.StructField("i", df.schema[id_col].dataType), T.StructField("x", T.BinaryType())])
    return df.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).mapInArrow(run, schema)


def column_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum of x - SHIFT per dimension)."""
    def run(batches):
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), dims)
            n, total = n + len(x), total + x.sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"at": np.arange(-1, dims), "t": np.concatenate(([n], total))})

    sums = dict(rows.select("x").mapInArrow(run, "at long, t long").groupBy("at")
                .agg(F.sum(F.col("t").cast("decimal(38,0)"))).collect())  # one row per dimension
    return int(sums.get(-1, 0)), [int(sums.get(d, 0)) for d in range(dims)]


def unpacked(col, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int32).reshape(-1, dims)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    q = np.array([t // n for t in total], np.int64)
    r = np.array([t % n / n for t in total])
    return (x - q) - r


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Sum over the dimensions of (n x - S)^2, exact, as Python integers where a long does not hold it."""
    q, r = np.array([t // n for t in total], np.int64), [t % n for t in total]
    step = x - q
    if x.shape[1] * (n * (int(np.abs(step).max(initial=0)) + 1)) ** 2 < 1 << 63:
        return np.square(n * step - np.array(r, np.int64)).sum(axis=1)
    return np.square(step.astype(object) * n - np.array(r, object)).sum(axis=1)


# ---- blocks ----------------------------------------------------------------------------------------------------------

def block_rows(n: int, dims: int) -> int:
    """Rows of a block; with n x dims numbers in all, both a block's size and the number of blocks grow with their root."""
    return max(1, BLOCK_VALUES // dims, int(np.ceil(np.sqrt(64 * n / dims))))


def row_blocks(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """Written rows of (block, ids, x): up to ``per_block`` rows each, numbered within their partition."""
    id_type = rows.schema["i"].dataType

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def pack():
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column(0).combine_chunks() if whole.num_rows else None
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([b"".join(whole.column(1).to_pylist())], pa.binary())], names=["block", "ids", "x"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, per_block - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == per_block:
                    yield pack()
                    block, held, size = block + 1, [], 0
        if held:
            yield pack()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("x", T.BinaryType())])
    return C.written(rows.select("i", "x").mapInArrow(run, schema), name)


class Numbers:
    """Consecutive numbers of the blocks of a written table, from the number of blocks of each writing task."""

    def __init__(self, blocks: DataFrame):
        counts = sorted(tuple(r) for r in blocks.groupBy(F.shiftright("block", 32).alias("p")).count().collect())  # tasks
        self.tasks = [p for p, _ in counts]
        self.base = np.concatenate(([0], np.cumsum([c for _, c in counts], dtype=np.int64))).tolist()
        self.count = self.base[-1]

    def number(self, block: int) -> int:
        return self.base[bisect.bisect_left(self.tasks, block >> 32)] + (block & 0xFFFFFFFF)

    def block(self, number: int) -> int:
        at = bisect.bisect_right(self.base, number) - 1
        return (self.tasks[at] << 32) + number - self.base[at]


MATRIX = T.StructType([T.StructField("_1", T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])),
                       T.StructField("_2", MatrixUDT())])
_FIELDS = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                     ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def matrix_blocks(numbers, matrices) -> pa.RecordBatch:
    """Rows ((number, 0), dense matrix), as MLlib keeps them in tables; the values go row after row."""
    none, n = pa.nulls(len(matrices)), [m.shape[0] for m in matrices]
    values = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([m.size for m in matrices]))).astype(np.int32),
                                      np.concatenate([m.ravel() for m in matrices]))
    dense = pa.StructArray.from_arrays(
        [pa.array([1] * len(n), pa.int8()), pa.array(n, pa.int32()), pa.array([m.shape[1] for m in matrices], pa.int32()),
         none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.int32())), values, pa.array([True] * len(n))],
        fields=list(_FIELDS))
    at = pa.StructArray.from_arrays([pa.array(numbers, pa.int64()), pa.array([0] * len(n), pa.int64())], names=["_1", "_2"])
    return pa.RecordBatch.from_arrays([at, dense], names=["_1", "_2"])


def matrix_of(blocks: DataFrame, numbers: Numbers, per_block: int, width: int, values) -> BlockMatrix:
    """The block matrix of ``values(bytes)``, an array of at most ``per_block`` rows, for every row (block, bytes) of ``blocks``.

    The blocks go to MLlib as a table of its own matrix type, so that no number becomes a Python object.
    """
    def make(batches):
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = values(raw.as_buffer())
                out = np.zeros((per_block, width))
                out[:len(rows)] = rows
                yield matrix_blocks([numbers.number(block)], [out])

    return block_matrix(blocks.mapInArrow(make, MATRIX), per_block, width, numbers.count * per_block, width)


def block_matrix(blocks: DataFrame, rows_per_block: int, cols_per_block: int, rows: int, cols: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows_per_block, cols_per_block, rows, cols),
                       rows_per_block, cols_per_block)


def product(a: BlockMatrix, b: BlockMatrix, middle: int = 1) -> BlockMatrix:
    """a times b; ``middle`` splits of the dimension that is summed over, each multiplied in a task of its own."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, middle)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(m: BlockMatrix, numbers: Numbers) -> np.ndarray:
    """m transposed times m, on the driver: as many numbers as the square of its columns."""
    return product(m.transpose(), m, max(1, numbers.count)).toLocalMatrix().toArray()


def projected(blocks: DataFrame, numbers: Numbers, per_block: int, dims: int, n: int, total: list[int],
              weights: np.ndarray, name: str) -> DataFrame:
    """Written rows of (block, y): the centred rows of each block times ``weights``, packed row after row."""
    def centre(raw):
        return centred(np.frombuffer(raw, np.int32).reshape(-1, dims), n, total)

    def finish(batches):
        for batch in batches:
            at, matrix = (batch.column(i) for i in (0, 1))
            for number, rows, cols, values, turned in zip(
                    at.field(0).to_pylist(), matrix.field("numRows").to_pylist(), matrix.field("numCols").to_pylist(),
                    matrix.field("values"), matrix.field("isTransposed").to_pylist()):
                flat = np.asarray(values.values)
                y = flat.reshape(rows, cols) if turned else flat.reshape(cols, rows).T
                yield pa.RecordBatch.from_pydict({"block": pa.array([numbers.block(number)], pa.int64()),
                                                  "y": pa.array([np.ascontiguousarray(y).tobytes()], pa.binary())})

    width = weights.shape[1]
    rows = matrix_of(blocks.select("block", "x"), numbers, per_block, dims, centre)
    spark = blocks.sparkSession
    one = spark.range(1, numPartitions=1).mapInArrow(lambda batches: (matrix_blocks([0], [weights]) for b in batches if b.num_rows), MATRIX)
    done = product(rows, block_matrix(one, dims, width, dims, width))
    table = callMLlibFunc("getMatrixBlocks", done._java_matrix_wrapper._java_model)
    return C.written(table.mapInArrow(finish, "block long, y binary"), name)


# ---- whitening -------------------------------------------------------------------------------------------------------

def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of the ``most`` largest that are not zero to rounding."""
    e, u = np.linalg.eigh(v)
    order = np.argsort(e)[::-1][:most]
    e, u = e[order], u[:, order]
    keep = e > max(e.max(initial=0), 0) * len(v) * np.finfo(float).eps
    e, u = e[keep], u[:, keep]
    return e, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(len(e))])


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every kept row and component."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("n", "deviation")),
                           *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    spark, dims = df.sparkSession, V.dimension(df, id_col, vec_col)
    if not dims:
        return spark.createDataFrame([], schema)
    rows = packed(df, id_col, vec_col, dims)
    fit = C.written(rows.select("x").distinct(), "fit")
    n, total = column_sums(fit, dims)
    per_block = block_rows(n, dims)
    fit_blocks = row_blocks(fit.withColumn("i", F.lit(None).cast(id_type)), per_block, "fit-blocks")
    numbers = Numbers(fit_blocks)

    def centre(raw):
        return centred(np.frombuffer(raw, np.int32).reshape(-1, dims), n, total)

    v = scatter(matrix_of(fit_blocks.select("block", "x"), numbers, per_block, dims, centre), numbers) / n
    e, u = eigen(v, components)
    if not len(e):
        return spark.createDataFrame([], schema)
    weights, width, explained = u / np.sqrt(e), len(e), e / np.trace(v)
    y = projected(fit_blocks, numbers, per_block, dims, n, total, weights, "fit-whitened")
    again = matrix_of(y, numbers, per_block, width, lambda raw: np.frombuffer(raw).reshape(-1, width))
    error = float(np.abs(scatter(again, numbers) / n - np.eye(width)).max())

    blocks = row_blocks(rows, per_block, "rows")
    y = projected(blocks, Numbers(blocks), per_block, dims, n, total, weights, "whitened")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[k].as_buffer(), np.int32).reshape(-1, dims)
                out = np.frombuffer(batch.column(2)[k].as_buffer()).reshape(-1, width)
                ids = batch.column(0)[k].values
                for at in range(0, len(x), 1 << 14):
                    part = x[at:at + (1 << 14)]
                    m, far = len(part), deviations(part, n, total)
                    far = pa.array(far) if far.dtype != object else pa.array([d if d < 1 << 63 else None for d in far], pa.int64())
                    each = pa.array(np.repeat(np.arange(m), width))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, m).take(each), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                         pa.array(np.full(m * width, n)), far.take(each), pa.array(out[at:at + m].ravel()),
                         pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error))], names=schema.names)

    return blocks.join(y, "block").select("ids", "x", "y").mapInArrow(run, schema)
