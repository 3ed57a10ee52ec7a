"""Sparse matrices as coordinate tables (matrix_id, row, col, value), vectors as (matrix_id, idx, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble(*contributions: DataFrame) -> DataFrame:
    """Sums of all contributions to each cell; zeros add nothing, a cell whose sum is 0 goes."""
    every = reduce(DataFrame.unionByName, (c.select("matrix_id", "row", "col", "value") for c in contributions))
    return every.where("value <> 0").groupBy("matrix_id", "row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def assign(writes: DataFrame, order: str = "seq") -> DataFrame:
    """The last write of each cell by ``order``; a last write of 0 erases the cell."""
    return writes.groupBy("matrix_id", "row", "col").agg(F.max_by("value", order).alias("value")).where("value <> 0")


def get(a: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` (matrix_id, row, col) with their values, 0 where the matrix has none."""
    return cells.join(a.select("matrix_id", "row", "col", F.col("value").alias("__v")), ["matrix_id", "row", "col"], "left").select(*cells.columns, F.coalesce("__v", F.lit(0.0)).alias("value"))


def _product(a: DataFrame, x: DataFrame, dims: DataFrame, over: str, to: str, size: str) -> DataFrame:
    terms = a.join(x.select("matrix_id", F.col("idx").alias(over), F.col("value").alias("__x")), ["matrix_id", over])
    sums = terms.groupBy("matrix_id", F.col(to).alias("idx")).agg(F.sum(F.col("value") * F.col("__x")).alias("__s"))
    every = dims.where(F.col(size) > 0).select("matrix_id", F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)).alias("idx"))
    return every.join(sums, ["matrix_id", "idx"], "left").select("matrix_id", "idx", F.coalesce("__s", F.lit(0.0)).alias("value"))


def multiply(a: DataFrame, x: DataFrame, dims: DataFrame) -> DataFrame:
    """A x; rows without entries give 0.  ``dims``: (matrix_id, n_rows, n_cols)."""
    return _product(a, x, dims, "col", "row", "n_rows")


def transpose_multiply(a: DataFrame, x: DataFrame, dims: DataFrame) -> DataFrame:
    """A' x; columns without entries give 0."""
    return _product(a, x, dims, "row", "col", "n_cols")


def normal_multiply(a: DataFrame, p: DataFrame, dims: DataFrame) -> DataFrame:
    """A' A p, without the product of the matrices."""
    return transpose_multiply(a, multiply(a, p, dims), dims)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """(matrix_id, dot)."""
    both = x.join(y.select("matrix_id", "idx", F.col("value").alias("__y")), ["matrix_id", "idx"])
    return both.groupBy("matrix_id").agg(F.sum(F.col("value") * F.col("__y")).alias("dot"))


def compressed(a: DataFrame) -> DataFrame:
    """Cells in row order with ``pos`` and their row's ``row_start``: compressed rows as a table.

    Positions come from counts a row and a running sum over rows, then a number within the row.
    """
    counts = a.where("value <> 0").groupBy("matrix_id", "row").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("matrix_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("matrix_id", "row", F.coalesce(before, F.lit(0)).alias("row_start"))
    inside = F.row_number().over(Window.partitionBy("matrix_id", "row").orderBy("col")) - 1
    return a.where("value <> 0").withColumn("__in", inside).join(starts, ["matrix_id", "row"]).select("matrix_id", "row", "col", "value", "row_start", (F.col("row_start") + F.col("__in")).alias("pos"))


def dims_of(a: DataFrame) -> DataFrame:
    return a.groupBy("matrix_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def row_of(a: DataFrame, row: int) -> DataFrame:
    return a.where(F.col("row") == row)


def dense_rows(a: DataFrame, dims: DataFrame) -> DataFrame:
    """(matrix_id, row, cells): each row as an array of all its columns, for small matrices shown in full."""
    rows = dims.select("matrix_id", F.col("n_cols").cast("int").alias("n_cols"), F.explode(F.sequence(F.lit(0), F.col("n_rows").cast("int") - 1)).alias("row"))
    cells = a.groupBy("matrix_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    value = F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return rows.join(cells, ["matrix_id", "row"], "left").select("matrix_id", "row", value.alias("cells"))


def check_vector(x: DataFrame, dims: DataFrame, size: str = "n_cols") -> None:
    """Raise where a vector's length is not the matrix's, or an index is out of range."""
    found = x.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    wrong = dims.join(found, "matrix_id", "left").where((F.coalesce("n", F.lit(0)) != F.col(size)) | (F.col("low") < 0) | (F.col("high") >= F.col(size))).select("matrix_id").take(3)
    if wrong:
        raise ValueError(f"vector length does not fit matrices {[r.matrix_id for r in wrong]}")
