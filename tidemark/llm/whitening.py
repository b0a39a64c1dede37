"""Whitening of embeddings by distributed block matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import discard, keep, ready

LARGEST = float(1 << 56)
BLOCK = 1 << 18
BLOCKS = 100_000
NO_VARIANCE = 1e-10
WIDE = "decimal(38,0)"


def fixed_point(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Entries as integers, floor(scale * entry) + shift; null for a null vector or one with a null, non-finite or huge (from 2^56) entry."""
    v = vector.cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))
    return F.when(usable, F.transform(v, lambda c: F.floor(c * scale) + shift))


def indexed(rows: DataFrame) -> DataFrame:
    """Rows of a written table with ``index``, gapless from 0, in place of ``__part`` and ``__at`` (partition at writing and place in it).

    One count for each partition comes to the driver and goes back as a running sum.
    """
    counts = rows.groupBy("__part").count().orderBy("__part").collect()
    starts = np.cumsum([0, *(r["count"] for r in counts)])
    table = rows.sparkSession.createDataFrame([(r["__part"], int(s)) for r, s in zip(counts, starts)], "__part int, __start long")
    return rows.join(F.broadcast(table), "__part").withColumn("index", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def block_rows(rows: int, columns: int) -> int:
    """Rows of a block: 2 MB of doubles, up to 32 MB where there would be over ``BLOCKS`` blocks, whose coordinates the driver lists."""
    least = max(1, BLOCK // columns)
    return min(max(least, -(-rows // BLOCKS)), 16 * least)


def blocks(rows: DataFrame, count: int, columns: int) -> BlockMatrix:
    """The matrix of rows (index, array of doubles ``row``), cut into blocks of rows; an index that is missing is a row of zeros."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, count, columns).toBlockMatrix(block_rows(count, columns), columns)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, columns by columns, on the driver.

    The blocks are spread over the middle dimension, one product a task and summed in pairs,
    so no task holds more than two blocks.
    """
    turned = matrix.transpose()._java_matrix_wrapper
    product = turned.call("multiply", matrix._java_matrix_wrapper._java_model, matrix.numRowBlocks)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(matrix: BlockMatrix, onto: np.ndarray) -> DataFrame:
    """index and ``row`` of the matrix times a local one."""
    context = matrix.blocks.context
    small = BlockMatrix(context.parallelize([((0, 0), Matrices.dense(*onto.shape, onto.ravel(order="F")))], 1), *onto.shape)
    product = matrix.multiply(small).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)  # stays in the JVM, as .rows doesn't
    return found.select("index", vector_to_array("vector").alias("row"))


def sums(rows: DataFrame, column: str, kind: str) -> list:
    """Sum of each dimension of an array column."""
    each = rows.select(F.posexplode(column).alias("__d", "__x")).groupBy("__d").agg(F.sum(F.col("__x").cast(kind)).alias("s"))
    return [r.s for r in each.orderBy("__d").collect()]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row for each usable vector and principal component: id, component (from 1), n, deviation, whitened, explained and identity_error.

    Entries become the integers of :func:`fixed_point`. The fit list is each distinct integer
    vector once: n vectors with sums S. Rows centred by S / n are indexed into blocks, their
    transpose times themselves is the scatter matrix, its eigenvectors are found on the driver
    (dimension by dimension, so memory there is bounded by the dimension alone), and the blocks
    times the scaled eigenvectors give ``whitened``. ``deviation`` is the sum of (n*x - S)^2, exact,
    null if it passes 64 bits. ``identity_error`` is the largest entry of whitened's covariance over
    the fit list minus the identity. Components whose variance is under 1e-10 of the first one's
    can't be scaled and are left out, so a fit list of one vector gives no rows.

    Null vectors and those with null, non-finite or huge entries (from 2^56, which would not fit) give no rows; of
    vectors of different lengths those of the most frequent one (the longest on a tie) stay.
    Ids may be null or repeat: each row is its own. Only the id column is carried along.
    """
    spark = vectors.sparkSession
    ready(spark)
    schema = vectors.select(F.col(f"`{id_col}`")).withColumns({c: F.lit(None).cast(t) for c, t in {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}.items()}).schema
    x = fixed_point(F.col(f"`{vector_col}`"), scale, shift)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    usable = vectors.select(F.col(f"`{id_col}`").alias("__id"), x.alias("x")).filter("size(x) > 0")
    table = keep(usable.select("__id", "x", F.spark_partition_id().alias("__part"), at.alias("__at")), "vectors")
    lengths = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    rows = indexed(table)
    total = table.count()
    rows = rows.filter(F.size("x") == d)
    fit = keep(rows.groupBy("x").agg(F.min("index").alias("index")), "fit")
    n, s = fit.count(), sums(fit, "x", WIDE)
    sum_of = F.split(F.lit(",".join(map(str, s))), ",").cast(f"array<{WIDE}>")
    apart = F.zip_with("x", sum_of, lambda a, b: (F.lit(n).cast("decimal(19,0)") * a.cast("decimal(19,0)") - b).cast(WIDE))
    centred = F.transform(apart, lambda a: a.cast("double") / n)
    variance, axes = np.linalg.eigh(scatter(blocks(fit.select("index", centred.alias("row")), total, d)) / n)
    trace = float(variance.sum())
    order = np.argsort(-variance)[:components]
    order = order[variance[order] > max(variance.max(), 0) * NO_VARIANCE]
    if not len(order):
        return spark.createDataFrame([], schema)
    whole = blocks(rows.select("index", centred.alias("row")), total, d)
    projected = keep(project(whole, axes[:, order] / np.sqrt(variance[order])), "whitened")
    fitted = projected.join(fit.select("index"), "index", "left_semi")
    mean = F.lit(np.array(sums(fitted, "row", "double")) / n)
    apart_again = fitted.select("index", F.zip_with("row", mean, lambda a, b: a - b).alias("row"))
    error = np.abs(scatter(blocks(apart_again, total, len(order))) / n - np.eye(len(order))).max()
    discard(fit)
    squared = F.aggregate(apart, F.lit(0).cast(WIDE), lambda acc, a: F.try_add(acc, F.try_multiply(a, a)).cast(WIDE))
    out = rows.select("index", "__id", squared.try_cast("long").alias("deviation")).join(projected, "index")
    share = F.lit(variance[order] / trace)
    out = out.select("__id", "deviation", F.posexplode("row").alias("__k", "whitened"))
    return out.select(
        F.col("__id").alias(id_col), (F.col("__k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("__k")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
