"""Embedding whitening with MLlib's distributed block matrices.

Whole-number vectors are centred and indexed into the row blocks of a BlockMatrix.  Its transpose
times itself is the scatter matrix, whose middle dimension is cut so that no task sees all rows;
the scatter, of the size of one vector squared, is solved by a local eigendecomposition; a second
product with the whitening matrix projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.llm.common import stored

#: Row blocks of a matrix: their keys are held by the driver, so there are never more.
MOST_BLOCKS = 4096

#: Components whose variance is under this share of the largest have none, to rounding.
NO_VARIANCE = 1e-12


def whole_numbers(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift, as long, for every component c.

    Rows whose vector is null or holds a null or non-finite component are left out.  A vector
    shorter than the longest counts as having zeros at its end.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & ~bad).select("vec_id", "embedding")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    padded = F.when(F.size("embedding") == width, F.col("embedding")).otherwise(
        F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size("embedding")))
    )
    return rows.select(
        "vec_id", F.transform(padded, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x")
    )


def _indexed(rows: DataFrame) -> DataFrame:
    """A stored copy of the rows with an `index` from 0 without gaps.

    Rows are numbered within the tasks that write them; the tasks' counts, one number each, give
    where their numbers start.
    """
    task, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    held = stored(rows.withColumn("_place", F.monotonically_increasing_id()))
    counts = held.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r.task, total))
        total += r.n
    first = rows.sparkSession.createDataFrame(starts, "_task long, _first long")
    return (
        held.withColumn("_task", task).join(F.broadcast(first), "_task")
        .withColumn("index", F.col("_first") + at).drop("_task", "_first", "_place")
    )


def _blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """A block matrix of (index, v) with n rows; one block is as wide as the matrix."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, width).toBlockMatrix(max(1024, -(-n // MOST_BLOCKS)), width)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Matrix product with the middle dimension dealt over `splits` groups of tasks.

    The Python class has no such argument, the class that it wraps has.
    """
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _gram(matrix: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself."""
    splits = max(1, min(matrix.numRowBlocks, MOST_BLOCKS) // 4)
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def whiten(numbers: DataFrame, components: int = 32) -> DataFrame:
    """Whitened coordinates of whole-number vectors (vec_id, x), all of one length.

    Returns for each row and component, numbered from 1 by falling variance: vec_id, component,
    n (rows), deviation (sum over the dimensions of (n * x - their sum) ** 2, exact while it fits
    a long, else an error), whitened (the centred row along the component over the root of its
    variance; divisor n), explained (the component's share of all variance), identity_error
    (largest entry, by amount, of the covariance of all whitened rows less the identity; one
    value).  Repeated rows count and come out as often as they stand there, rows without vec_id
    as well.  Components without variance have no whitened coordinate and are left out: fewer
    rows than dimensions have fewer components, and no or only equal rows give no row at all.
    """
    spark = numbers.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    held = _indexed(numbers)
    # One row per dimension; tasks add up before anything moves.
    sums = held.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(
        F.sum("value").alias("s"), F.count("*").alias("n")
    ).orderBy("at").collect()
    if not sums:
        return spark.createDataFrame([], schema)
    n, width, total = sums[0].n, len(sums), [r.s for r in sums]
    # n * x - S is exact, so a centred value has one rounding.
    off = F.zip_with("x", F.lit(total).cast("array<long>"), lambda x, s: x * F.lit(n).cast("long") - s)
    centred = _blocks(held.select("index", F.transform(off, lambda d: d.cast("double") / n).alias("v")), n, width)
    covariance = _gram(centred) / n
    variance, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    falling = np.argsort(-variance, kind="stable")[:components]
    falling = falling[variance[falling] > NO_VARIANCE * max(variance.max(), 0)]
    if not len(falling):
        return spark.createDataFrame([], schema)
    turned = vectors[:, falling] / np.sqrt(variance[falling])
    explained = (variance[falling] / np.trace(covariance)).tolist()
    # The whitening matrix is one block, sent to the row blocks' tasks.
    sc = spark.sparkContext
    own = DenseMatrix(width, len(falling), turned.ravel(order="F").tolist())
    projected = _product(centred, BlockMatrix(sc.parallelize([((0, 0), own)], 1), width, len(falling)), 1)
    rows = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    rows = stored(rows.select("index", vector_to_array("vector").alias("v")))
    # Rows were centred before they were multiplied, so their images have mean zero.
    spread = _gram(_blocks(rows, n, len(falling))) / n
    error = float(np.abs(spread - np.eye(len(falling))).max())
    squares = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda s, d: (s + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return (
        held.select("index", "vec_id", squares.cast("long").alias("deviation")).join(rows, "index")
        .select("vec_id", "deviation", F.posexplode(F.arrays_zip("v", F.lit(explained).alias("e"))).alias("at", "one"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            F.col("one.v").alias("whitened"),
            F.col("one.e").alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
