"""Objectives, constraints and descriptors of many candidates in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import contrast, fit, prepare


def signature(rows: Column, columns: Column) -> Column:
    """SHA-256 of ``r:0,2|c:1,3``."""
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    return F.sha2(F.concat(F.lit("r:"), text(rows), F.lit("|c:"), text(columns)), 256)


def coherence(errors: DataFrame, columns: DataFrame) -> DataFrame:
    """candidate, coherence: root mean square of the column errors, 1 for a column without a fit."""
    e = columns.join(errors.select("candidate", "column_index", "error"), ["candidate", "column_index"], "left").withColumn("e", F.coalesce("error", F.lit(1.0)))
    return e.groupBy("candidate").agg(F.least(F.lit(1.0), F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("coherence"))


def balanced_size(n_rows: Column, n_columns: Column, all_rows: int | Column, all_columns: int | Column) -> Column:
    """Harmonic mean of the row and column coverage."""
    r, c = n_rows / all_rows, n_columns / all_columns
    return 2 * r * c / (r + c)


def size_constraint(value: Column, low: float, high: float) -> Column:
    """Violation of ``low <= value <= high``; at most 0 is feasible."""
    return F.greatest(F.lit(low) - value, value - F.lit(high))


def coherence_constraint(value: Column, maximum: float = 0.10) -> Column:
    return value - F.lit(maximum)


def violation(*values: Column) -> Column:
    return sum((F.greatest(F.lit(0.0), v) for v in values), F.lit(0.0))


def mean_loss(objectives: DataFrame) -> DataFrame:
    """candidate, loss from (candidate, direction, value): what is maximised counts as 1 - value; without objectives infinite."""
    loss = F.when(F.col("direction") == "MINIMIZE", F.col("value")).otherwise(1 - F.col("value"))
    return objectives.groupBy("candidate").agg(F.coalesce(F.avg(loss), F.lit(float("inf"))).alias("loss"))


def evaluate_constant(cells: DataFrame, rows: DataFrame, columns: DataFrame, stats: DataFrame, ratio: float = 0.8, max_coherence: float = 0.30) -> DataFrame:
    """candidate, n_rows, n_columns, coherence, contrast, size, violation, feasible of numeric candidates under the constant pattern.

    The cells inside the candidates and their fits are each needed twice, so both are written to the shared folder once.
    """
    used = cells.join(columns.select("column_index").distinct(), "column_index", "left_semi")
    inside = cut(fit.submatrix(used, rows, columns), "inside")
    fits = cut(fit.constant_fit_numeric(inside, stats, ratio), "fits")
    c = contrast.constant_contrast_numeric(used, rows, columns, fits, inside=inside)
    c = columns.join(c, ["candidate", "column_index"], "left").groupBy("candidate").agg(F.avg(F.coalesce("contrast", F.lit(0.0))).alias("contrast"))
    n = rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_rows")).join(columns.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_columns")), "candidate")
    whole = cells.agg(F.count_distinct("row_index").alias("__rows"), F.count_distinct("column_index").alias("__columns"))
    out = n.join(coherence(fits, columns), "candidate").join(c, "candidate").crossJoin(F.broadcast(whole))  # one row
    out = out.withColumn("size", balanced_size(F.col("n_rows"), F.col("n_columns"), F.col("__rows"), F.col("__columns")))
    v = violation(coherence_constraint(F.col("coherence"), max_coherence), size_constraint(F.col("size"), 0.0, 1.0))
    return out.withColumn("violation", v).withColumn("feasible", F.col("violation") <= 0).drop("__rows", "__columns")


__all__ = ["signature", "coherence", "balanced_size", "evaluate_constant", "prepare", "mean_loss", "violation", "size_constraint", "coherence_constraint"]
