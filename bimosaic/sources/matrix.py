"""Wide tables to the long ``cells`` relation: row_index, column_index, num (numeric) or code (discrete, 0-based), null where missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_cells(df: DataFrame, key: str, columns: dict[int, str]) -> DataFrame:
    """``columns``: column_index by name of the wide table. One Expand per scan; the id filter reaches the scan."""
    ids = {v: k for k, v in columns.items()}
    wide = df.select(F.col(key).cast("long").alias("row_index"), *[F.col(c).cast("double").alias(str(i)) for i, c in columns.items()])
    long = wide.unpivot("row_index", [str(i) for i in ids.values()], "name", "num")
    return long.select("row_index", F.col("name").cast("int").alias("column_index"), "num", F.lit(None).cast("int").alias("code"))


def array_cells(df: DataFrame, key: str, array: str) -> DataFrame:
    """One numeric column for each element of an array column."""
    long = df.select(F.col(key).cast("long").alias("row_index"), F.posexplode(array).alias("column_index", "num"))
    return long.select("row_index", "column_index", F.col("num").cast("double").alias("num"), F.lit(None).cast("int").alias("code"))


def encode(value: Column, categories: list[str]) -> Column:
    """Position of a label among the declared categories; an undeclared label fails the job."""
    at = F.array_position(F.array(*map(F.lit, categories)), value).cast("int")
    return F.when(value.isNull(), None).when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("undeclared category: "), value)))


def discrete_cells(df: DataFrame, key: str, columns: dict[int, tuple[str, list[str]]]) -> DataFrame:
    wide = df.select(F.col(key).cast("long").alias("row_index"), *[encode(F.col(c).cast("string"), cats).alias(str(i)) for i, (c, cats) in columns.items()])
    long = wide.unpivot("row_index", [str(i) for i in columns], "name", "code")
    return long.select("row_index", F.col("name").cast("int").alias("column_index"), F.lit(None).cast("double").alias("num"), "code")


def reject_not_finite(cells: DataFrame) -> DataFrame:
    """Observed NaN or infinity is an error; missing is null only."""
    bad = F.isnan("num") | (F.abs("num") == float("inf"))
    return cells.withColumn("num", F.when(bad, F.raise_error(F.lit("observed values must be finite"))).otherwise(F.col("num")))


def slice_cells(cells: DataFrame, rows: list[int], columns: list[int]) -> DataFrame:
    """A source-matrix slice; both filters reach the scan."""
    return cells.filter(F.col("row_index").isin(rows) & F.col("column_index").isin(columns))
