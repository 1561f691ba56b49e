"""Prepared tables as a folder: cells, columns and a manifest, checked when they are read.

``columns`` has column_index, name, kind (numeric or discrete) and categories (labels of a discrete column, else null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import beside, put

MANIFEST = "identifier string, n_rows long, n_columns long, n_cells long, digest string"


def fingerprint(cells: DataFrame) -> DataFrame:
    """One row: n_cells and a digest of all cells, whatever their order: the sum of a 64-bit hash a cell, as text."""
    h = F.xxhash64("row_index", "column_index", "num", "code").cast("decimal(38,0)")
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def faults(cells: DataFrame, columns: DataFrame, n_rows: int) -> DataFrame:
    """One row that counts what a sound bundle has none of: rows out of range, undeclared columns, values of the wrong kind, codes
    without a category, values that are not finite, and cells given twice. All but the last in one aggregate over one scan."""
    c = columns.select("column_index", "kind", F.size("categories").alias("labels"))
    x = cells.join(c, "column_index", "left")
    wrong = (F.col("num").isNotNull() & (F.col("kind") != "numeric")) | (F.col("code").isNotNull() & (F.col("kind") != "discrete"))
    one = x.agg(
        F.count_if(~F.col("row_index").between(0, n_rows - 1)).alias("bad_rows"), F.count_if(F.col("kind").isNull()).alias("bad_columns"), F.count_if(wrong).alias("bad_kinds"),
        F.count_if((F.col("kind") == "discrete") & ~F.col("code").between(0, F.col("labels") - 1)).alias("bad_codes"),
        F.count_if(F.isnan("num") | (F.abs("num") == float("inf"))).alias("not_finite"),
    )
    twice = cells.groupBy("row_index", "column_index").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return one.crossJoin(twice)  # one row each


def _check(cells: DataFrame, columns: DataFrame, n_rows: int) -> None:
    found = {k: v for k, v in faults(cells, columns, n_rows).first().asDict().items() if v}
    names = columns.agg((F.count(F.lit(1)) - F.count_distinct("name")).alias("n")).first()["n"]
    if names:
        found["repeated_names"] = names
    if found:
        raise ValueError(f"unsound bundle: {found}")


def write_bundle(cells: DataFrame, columns: DataFrame, n_rows: int, path: str, identifier: str) -> None:
    """Checks, writes beside its place and renames, so a reader sees the whole bundle or none; what is there already is not touched."""
    _check(cells, columns, n_rows)
    whole, path = path, beside(path)
    cells.select("row_index", "column_index", "num", "code").write.option("compression", "zstd").parquet(f"{path}/cells")
    columns.write.option("compression", "zstd").parquet(f"{path}/columns")
    spark = cells.sparkSession
    kept = fingerprint(spark.read.parquet(f"{path}/cells"))
    kept.select(F.lit(identifier).alias("identifier"), F.lit(n_rows).cast("long").alias("n_rows"), F.lit(columns.count()).alias("n_columns"), "n_cells", "digest").coalesce(1).write.json(f"{path}/manifest")
    put(spark, path, whole)


def inspect_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Manifest and columns; no cell is read."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest"), spark.read.parquet(f"{path}/columns")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells and columns, after the digest, the number of columns and all checks hold."""
    manifest, columns = inspect_bundle(spark, path)
    m = manifest.first()
    cells = spark.read.parquet(f"{path}/cells")
    f = fingerprint(cells).first()
    if (f["n_cells"], f["digest"], columns.count()) != (m["n_cells"], m["digest"], m["n_columns"]):
        raise ValueError("the bundle's tables differ from its manifest")
    _check(cells, columns, m["n_rows"])
    return cells, columns
