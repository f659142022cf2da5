"""Whitening of embeddings with distributed block matrices.

Entries become integers on a grid, so that sums and distances from the mean are exact.
Centred rows are dealt to the blocks of a ``BlockMatrix`` B; the scatter B'B is one block
product, its eigenvectors are found on the driver, and B times the scaled eigenvectors
gives the whitened rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix, RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm.common import release, written

#: Bytes and columns of a full block.
BLOCK_BYTES, BLOCK_COLUMNS = 1 << 20, 1024
#: Entries whose grid value would not fit a long with room for differences.
_TOO_LARGE = float(1 << 61)
_PLACE_BITS = 33


@dataclass(frozen=True)
class Fit:
    """What is learned from the distinct grid vectors of one dimension."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray  # falling, of the grid vectors' covariance
    vectors: np.ndarray  # one unit eigenvector in each column
    trace: float

    @property
    def rank(self) -> int:
        """Components with more variance than rounding leaves."""
        least = len(self.sums) * np.finfo(float).eps * max(self.eigenvalues[0], 0)
        return int(np.sum(self.eigenvalues > least))

    def projection(self, components: int) -> np.ndarray:
        """Eigenvectors over the root of their eigenvalues; zero where there is no variance."""
        scaled = self.vectors[:, :components].copy()
        scaled[:, : self.rank] /= np.sqrt(self.eigenvalues[: min(self.rank, components)])
        scaled[:, self.rank :] = 0
        return scaled


def grid(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``id, x``: floor(scale * c) + shift for every entry c of the sound vectors."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & (F.abs(c * scale) < _TOO_LARGE))
    x = F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift).cast("long"))
    return given.filter(F.coalesce(sound, F.lit(False))).select("id", x.alias("x"))


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` with a gapless ``row`` number, and how many rows there are.

    Rows are written with their place in a partition first, so that a number stays the same
    whatever is computed again.  One count per partition is sent to all tasks.
    """
    table = written(df.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", _PLACE_BITS).alias("part")
    counts = table.groupBy(part).agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    row = (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).alias("row")
    placed = table.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.select(row, *df.columns), table.count()


def _literal(values: list, kind: str) -> Column:
    """An array of numbers, handed over as one piece of SQL text."""
    typed = {"long": "{}L", "double": "{!r}D", "decimal(19,0)": "{}BD"}[kind]
    items = ", ".join("null" if v is None else typed.format(v) for v in values)
    return F.expr(f"cast(array({items}) as array<{kind}>)")


def _off(n: int, sums: list[int]) -> tuple[Column, list[int]]:
    """x - q as exact integers, and r, with S = n q + r for every dimension."""
    parts = [divmod(s, n) for s in sums]
    off = F.zip_with("x", _literal([q for q, _ in parts], "long"), lambda a, q: a - q)
    return off, [r for _, r in parts]


def _centred(n: int, sums: list[int]) -> Column:
    """x - S/n as doubles, rounded once."""
    off, rest = _off(n, sums)
    return F.zip_with(off.cast("array<double>"), _literal([r / n for r in rest], "double"), lambda a, r: a - r)


def _deviation(n: int, sums: list[int]) -> Column:
    """The exact sum of (n x - S)^2 as a long, NULL if none can hold it."""
    off, rest = _off(n, sums)
    wide = F.zip_with(
        off.cast("array<decimal(19,0)>"),
        _literal(rest, "decimal(19,0)"),
        lambda a, r: a * F.lit(n).cast("decimal(19,0)") - r,
    )
    total = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda t, a: (t + a * a).cast("decimal(38,0)"))
    return total.try_cast("long")


def _blocks(rows: DataFrame, n_rows: int, n_columns: int) -> BlockMatrix:
    """A ``row, c`` table of arrays as a block matrix; rows that are missing are zero."""
    typed = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector("c").alias("c")), "c")
    high = max(16, BLOCK_BYTES // (8 * min(n_columns, BLOCK_COLUMNS)))
    return IndexedRowMatrix(typed, n_rows, n_columns).toBlockMatrix(high, BLOCK_COLUMNS)


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left * right``, the sum over inner blocks cut into so many tasks for each result block."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _fit(distinct: DataFrame, n_rows: int, dimension: int) -> Fit:
    entries = distinct.select(F.posexplode("x").alias("i", "c"))
    totals = entries.groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted(totals.collect())  # one row per dimension
    n, sums = found[0].n, [int(r.s) for r in found]
    matrix = _blocks(distinct.select("row", _centred(n, sums).alias("c")), n_rows, dimension)
    tasks = max(1, min(matrix.numRowBlocks, 2 * distinct.sparkSession.sparkContext.defaultParallelism))
    scatter = _multiply(matrix.transpose(), matrix, tasks).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(dimension)] < 0, -1.0, 1.0)
    return Fit(n, sums, values, vectors, float(np.trace(covariance)))


def _projected(rows: DataFrame, n_rows: int, fit: Fit, components: int) -> DataFrame:
    """``row, z``: the block product of the centred rows and the projection."""
    spark = rows.sparkSession
    matrix = _blocks(rows.select("row", _centred(fit.n, fit.sums).alias("c")), n_rows, len(fit.sums))
    scaled = [(i, Vectors.dense(r)) for i, r in enumerate(fit.projection(components).tolist())]
    typed = MLUtils.convertVectorColumnsFromML(spark.createDataFrame(scaled, ["row", "c"]), "c")
    right = IndexedRowMatrix(typed, len(scaled), components).toBlockMatrix(BLOCK_COLUMNS, components)
    product = matrix.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return found.select(F.col(found.columns[0]).alias("row"), vector_to_array(found.columns[1]).alias("z"))


def _identity_error(whitened: DataFrame, distinct: DataFrame, n: int, rank: int) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity, measured on the rows."""
    if n < 2 or not rank:
        return None
    kept = F.slice("z", 1, rank)
    rows = whitened.join(distinct.select("row"), "row", "left_semi").select(array_to_vector(kept).alias("z"))
    covariance = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "z")).computeCovariance().toArray()
    return float(np.abs(covariance * (n - 1) / n - np.eye(len(covariance))).max())


def _whiten(given: DataFrame, dimension: int, components: int) -> DataFrame:
    """The result for the vectors of one dimension."""
    components = min(components, dimension)
    rows, n_rows = numbered(given, "grid-vectors")
    distinct = written(rows.groupBy("x").agg(F.min("row").alias("row")), "distinct-vectors")
    fit = _fit(distinct, n_rows, dimension)
    whitened = written(_projected(rows, n_rows, fit, components), "whitened")
    rank = min(fit.rank, components)
    error = _identity_error(whitened, distinct, fit.n, rank)
    release(distinct)
    explained = [float(e / fit.trace) if fit.trace else None for e in fit.eigenvalues[:components]]
    component = (F.col("at") + 1).alias("component")
    return (
        rows.select("row", "id", _deviation(fit.n, fit.sums).alias("deviation"))
        .join(whitened, "row")
        .select("id", "deviation", F.posexplode("z").alias("at", "value"))
        .select(
            "id",
            component,
            F.lit(fit.n).cast("long").alias("n"),
            "deviation",
            F.when(F.col("at") < rank, F.col("value")).alias("whitened"),
            F.element_at(_literal(explained, "double"), F.col("at") + 1).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )


def whiten(
    vectors: DataFrame,
    *,
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """A row per vector and component: ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry ``c`` counts as the integer ``floor(scale * c) + shift``.  Mean, covariance
    (divisor ``n``) and eigenvectors are those of the ``n`` distinct integer vectors; repeated
    vectors count once there, and every row is projected.  Components are numbered by falling
    variance; the largest entry of an eigenvector is positive.  Equal variances leave the
    choice of directions between them open.

    ``deviation`` is the exact sum of ``(n x - S)^2``, NULL if no long can hold it.  A component
    without variance has NULL for ``whitened``; ``identity_error`` is measured on the others
    and NULL if there are none, as for a single distinct vector.  A vector that is null, or holds an entry that is null,
    not finite or of 2**61 and more after scaling, takes no part.  Vectors of each dimension are fitted by
    themselves; those without entries give no rows, nor does an empty table.  Ids may be null or
    repeat: each row is projected.  Other columns are left out, whatever their names.

    Vectors travel as doubles: once to find the distinct ones, and by blocks of about a MiB
    once to their block and once to each product.  The driver holds matrices of dimension by
    dimension and one coordinate pair per block.
    """
    spark = vectors.sparkSession
    given = written(grid(vectors, id_col, vector_col, scale, shift), "grid")
    found = given.filter(F.size("x") > 0).select(F.size("x").alias("d")).distinct().orderBy("d")
    parts = [_whiten(given.filter(F.size("x") == r.d), r.d, components) for r in found.collect()]
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts, empty).withColumnRenamed("id", id_col)
