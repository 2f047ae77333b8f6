"""Whitening of embeddings with distributed block matrices.

Each vector becomes whole numbers x. Centred rows, indexed without a gap, are dealt into the
blocks of a distributed matrix A; its transpose times itself is the scatter matrix, whose size
depends on the dimension alone, so that the eigenvectors are found on the driver; A times the
whitening matrix (eigenvectors over roots of eigenvalues) projects every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from glasswake.llm.common import cut

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**20            # entries of this size or more are no embedding's
COMPONENTS = 8
BLOCK_ROWS, BLOCK_COLS = 1024, 1024
BLOCKS_PER_PART = 64         # row blocks that one task of the scatter product takes
WHOLE = "decimal(38,0)"


@dataclass
class Fit:
    """What whitening learns: number of vectors, sums by dimension, covariance, its falling
    eigenvalues and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    def is_flat(self, k: int) -> bool:
        """No variance along component ``k`` but what rounding leaves."""
        return not self.values[k] > self.values[0] * len(self.values) * 2.0**-52

    def whitener(self, k: int) -> np.ndarray:
        """One column for each of the first ``k`` components; flat ones are zero."""
        return np.column_stack([np.zeros(len(self.values)) if self.is_flat(i)
                                else self.vectors[:, i] / np.sqrt(self.values[i]) for i in range(k)])


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long): floor(1024 c) + 100000 of every entry, and ``row``, which
    numbers the rows from 0 without a gap; written as a table. Left out are vectors that are
    null, hold a null or an entry that is not finite (or of 2^20 and more), and those whose
    length is 0 or not the most frequent one (of equally frequent ones, the longest)."""
    c = F.col("embedding").cast("array<double>")
    good = vectors.select("vec_id", c.alias("c")).where(F.forall("c", lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False))))
    good = good.where(F.size("c") > 0)
    usual = good.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    good = good.where(F.size("c") == (usual["d"] if usual else 0))
    at = F.monotonically_increasing_id()
    kept = cut(good.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"), at.alias("at")),
               "whole-numbers")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))      # one row a task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (kept.withColumn("part", part).join(base, "part")
            .select("vec_id", "x", (F.col("base") + within).alias("row")))


def block_matrix(rows: DataFrame, row: str, values: Column, n: int, d: int) -> BlockMatrix:
    """The rows (numbered by ``row``, arrays ``values`` of length ``d``) in blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(row).alias("index"), array_to_vector(values).alias("vector")))
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(BLOCK_ROWS, min(d, BLOCK_COLS))


def scatter(a: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. Row blocks are multiplied in parts and the products, as
    large as the dimension squared, are summed; no task gets all rows."""
    parts = max(1, -(-(-(-a.numRows() // a.rowsPerBlock)) // BLOCKS_PER_PART))
    left = a.transpose()
    product = left._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, parts)
    got = BlockMatrix(product, left.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()
    return (got + got.T) / 2


def _difference(x: str, fit_n: int, sums: list[int]) -> Column:
    """n x - S by dimension, exact."""
    total = F.array(*[F.lit(str(s)).cast(WHOLE) for s in sums])
    n = F.lit(str(fit_n)).cast("decimal(18,0)")
    return F.zip_with(x, total, lambda v, s: (v.cast("decimal(19,0)") * n - s).cast(WHOLE))


def centred(n: int, sums: list[int]) -> Column:
    return F.transform(_difference("x", n, sums), lambda v: v.cast("double") / n)


def fit(rows: DataFrame) -> Fit | None:
    """Fits all rows of ``whole_numbers``; None without rows."""
    got = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("i").collect()      # one row a dimension
    if not got:
        return None
    n, sums = got[0]["n"], [r["s"] for r in got]
    covariance = scatter(block_matrix(rows, "row", centred(n, sums), n, len(sums))) / n
    values, vectors = np.linalg.eigh(covariance)
    return Fit(n, sums, covariance, values[::-1], vectors[:, ::-1])


def project(rows: DataFrame, model: Fit, k: int) -> DataFrame:
    """row, projected (array of the first ``k`` whitened components), written as a table."""
    d = len(model.sums)
    spark = rows.sparkSession
    columns = spark.createDataFrame(list(enumerate(model.whitener(k).tolist())), "index long, v array<double>")
    side = MLUtils.convertVectorColumnsFromML(columns.select("index", array_to_vector("v").alias("vector")))
    side = IndexedRowMatrix(side, d, k).toBlockMatrix(min(d, BLOCK_COLS), k)
    a = block_matrix(rows, "row", centred(model.n, model.sums), model.n, d)
    product = a.multiply(side).toIndexedRowMatrix()
    out = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return cut(out.select(F.col("index").alias("row"), vector_to_array("vector").alias("projected")), "projected")


def identity_error(projected: DataFrame, model: Fit, k: int) -> float | None:
    """Largest absolute entry of the covariance of what was projected, minus the identity, over
    the components that are not flat; None if all are."""
    kept = [i for i in range(k) if not model.is_flat(i)]
    if not kept:
        return None
    means = projected.agg(*[F.avg(F.col("projected")[i]) for i in range(k)]).first()
    values = F.zip_with("projected", F.array(*map(F.lit, means)), lambda v, m: v - m)
    got = scatter(block_matrix(projected, "row", values, model.n, k)) / model.n
    return float(np.abs((got - np.eye(k))[np.ix_(kept, kept)]).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per remaining row of ``vectors`` (vec_id, embedding) and component, up to ``components``
    or the dimension: vec_id, component (from 1, by falling eigenvalue), n, deviation (exact
    sum of (n x - S)^2; null where a long cannot hold it), whitened, explained, identity_error.

    ``whole_numbers`` says which rows remain. Repeated rows and null ids each keep their own
    rows. Along a flat component (no variance: fewer vectors than dimensions, or all equal)
    whitened is null, and so is explained if nothing varies at all. An empty table gives an
    empty result; further columns are ignored.
    """
    rows = whole_numbers(vectors)
    model = fit(rows)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(components, len(model.sums))
    projected = project(rows, model, k)
    error = identity_error(projected, model, k)
    flat = F.array(*[F.lit(model.is_flat(i)) for i in range(k)])
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values[:k]])
    square = F.aggregate(_difference("x", model.n, model.sums), F.lit("0").cast(WHOLE),
                         lambda total, v: (total + (v * v).cast(WHOLE)).cast(WHOLE))
    return (rows.select("vec_id", "row", square.alias("square")).join(projected, "row")
            .select("vec_id", "square", F.posexplode("projected").alias("i", "v"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("i") + 1).alias("component"),
                    F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(square AS long)").alias("deviation"),
                    F.when(~flat[F.col("i")], F.col("v")).alias("whitened"), shares[F.col("i")].alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
