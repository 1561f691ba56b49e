"""Biclusters found by other tools, read from JSON into memberships (id, row_index) and (id, column_index) without inventing scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _inside(element: Column, bound: Column, what: str) -> Column:
    """``element``; a job that meets an index outside 0 .. bound - 1 fails."""
    return F.when((element >= 0) & (element < bound), element).otherwise(F.raise_error(F.concat(F.lit(f"{what} outside the dataset: "), element.cast("string"))).cast("long"))


def coordinate_sets(documents: DataFrame, algorithm: str) -> DataFrame:
    """source, id, rows, columns of ``documents`` (source, json): ``[{"rows": [...], "columns": [...]}, ...]`` with indices or boolean masks.

    Identifiers number a document's biclusters from 0; indices are distinct and ascending.
    """
    schema = "array<struct<rows: array<string>, columns: array<string>>>"
    sets = documents.select("source", F.posexplode(F.from_json("json", schema)).alias("at", "b"))
    listed = lambda c: F.when(F.exists(c, lambda v: v.isin("true", "false")), F.filter(F.transform(c, lambda v, i: F.when(v == "true", i.cast("long"))), lambda v: v.isNotNull())).otherwise(F.transform(c, lambda v: v.cast("long")))
    name = F.format_string(f"{algorithm.lower().replace('_', '-')}-%06d", F.col("at"))
    return sets.select("source", name.alias("id"), *[F.array_sort(F.array_distinct(listed(F.col(f"b.{c}")))).alias(c) for c in ("rows", "columns")])


def members(sets: DataFrame, bounds: DataFrame, side: str, element: str) -> DataFrame:
    """source, id, element of one side (``rows`` or ``columns``); bounds (source, rows, columns) are the sizes of the datasets."""
    x = sets.select("source", "id", F.explode(side).alias("__e")).join(bounds.select("source", F.col(side).alias("__n")), "source")
    return x.select("source", "id", _inside(F.col("__e"), F.col("__n"), element).alias(element))


def planted(documents: DataFrame) -> DataFrame:
    """source, id, kind, rows, columns, pattern, noise of generated datasets' truth (source, json): ``{"biclusters": {id: {Type, X, Y, RowPattern, %Noise}}}``.

    Mixed biclusters name Rows, NumericColumns and SymbolicColumns instead of X and Y. Decimal commas are read.
    """
    one = "struct<Type: string, X: array<long>, Y: array<long>, Rows: array<long>, NumericColumns: array<long>, SymbolicColumns: array<long>, RowPattern: string, ColumnPattern: string, `%Noise`: string>"
    b = documents.select("source", F.explode(F.from_json("json", f"struct<biclusters: map<string, {one}>>")["biclusters"]).alias("id", "b"))
    none = F.array().cast("array<bigint>")
    columns = F.coalesce("b.Y", F.concat(F.coalesce("b.NumericColumns", none), F.coalesce("b.SymbolicColumns", none)))
    return b.select(
        "source", "id", F.lower("b.Type").alias("kind"), F.array_sort(F.coalesce("b.X", "b.Rows")).alias("rows"), F.array_sort(columns).alias("columns"),
        F.coalesce("b.RowPattern", "b.ColumnPattern").alias("pattern"), F.regexp_replace(F.col("b.%Noise"), ",", ".").cast("double").alias("noise"),
    )
