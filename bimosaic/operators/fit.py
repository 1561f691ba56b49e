"""Pattern fits of many candidates at once.

``rows`` (candidate, row_index) and ``columns`` (candidate, column_index) say which cells a candidate has. Constant fits and
fits with given column parameters are DataFrame plans; ``joint`` has the alternating medians.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prepare import ZERO, required_support


def submatrix(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """candidate, row_index, column_index, num, code (and observed, if there) of the cells inside each candidate.

    Rows meet columns before cells: the places inside candidates are no more than the result has (in a table without gaps), while cells
    meeting columns first are as many as the table's cells times the candidates that share a column, all dealt out by candidate and row.
    """
    own = ["observed"] if "observed" in cells.columns else []
    return rows.join(columns, "candidate").join(cells, ["row_index", "column_index"]).select("candidate", "row_index", "column_index", "num", "code", *own)


def supported(inside: DataFrame, value: str, ratio: float = 0.8) -> DataFrame:
    """candidate, column_index, n_rows, support, enough."""
    out = inside.groupBy("candidate", "column_index").agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("support"))
    return out.withColumn("enough", F.col("support") >= required_support(F.col("n_rows"), ratio=ratio))


def constant_fit_numeric(inside: DataFrame, stats: DataFrame, ratio: float = 0.8) -> DataFrame:
    """candidate, column_index, parameter, error, support: median and mean clipped deviation over the column's range."""
    p = inside.groupBy("candidate", "column_index").agg(F.median("num").alias("parameter"), F.count("num").alias("support"), F.count(F.lit(1)).alias("n_rows"))
    p = p.filter(F.col("support") >= required_support(F.col("n_rows"), ratio=ratio)).join(stats.select("column_index", "robust_range"), "column_index")
    d = F.abs(F.col("num") - F.col("parameter"))
    e = F.when(F.col("robust_range") > ZERO, F.least(F.lit(1.0), d / F.col("robust_range"))).otherwise((d > ZERO).cast("double"))
    out = inside.filter("num IS NOT NULL").join(p, ["candidate", "column_index"])
    return out.groupBy("candidate", "column_index", "parameter", "support").agg(F.avg(e).alias("error"))


def constant_fit_discrete(inside: DataFrame, freq: DataFrame, ratio: float = 0.8) -> DataFrame:
    """candidate, column_index, mode, error, support: misses of the mode over what a uniform column would miss."""
    counts = inside.groupBy("candidate", "column_index", "code").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("candidate", "column_index").agg(
        F.max(F.when(F.col("code").isNotNull(), F.struct("n", (-F.col("code")).alias("m")))).alias("top"),
        F.sum(F.when(F.col("code").isNotNull(), F.col("n"))).alias("support"), F.sum("n").alias("n_rows"),
    )
    g = freq.groupBy("column_index").agg(F.count(F.lit(1)).alias("g"))
    out = out.filter(F.col("support") >= required_support(F.col("n_rows"), ratio=ratio)).join(g, "column_index")
    miss = (1 - F.col("top.n") / F.col("support")) / (1 - 1 / F.col("g"))
    return out.select("candidate", "column_index", (-F.col("top.m")).alias("mode"), F.when(F.col("g") > 1, miss).otherwise(0.0).alias("error"), "support")


def residual_scale(robust_range: Column, median: Column) -> Column:
    return F.when(robust_range > ZERO, robust_range).otherwise(F.greatest(F.abs(median), F.lit(1.0)))


def scaled_cells(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """``cells`` with num divided by its column's residual scale; stats (column_index, robust_range, median)."""
    scale = stats.select("column_index", residual_scale(F.col("robust_range"), F.col("median")).alias("__scale"))
    return cells.join(scale, "column_index").withColumn("num", F.col("num") / F.col("__scale")).drop("__scale")


def additive_row_effects(cells: DataFrame, columns: DataFrame, beta: DataFrame, ratio: float = 0.8) -> DataFrame:
    """candidate, row_index, alpha for all rows: median over the candidate's columns of x - beta; beta (candidate, column_index, beta)."""
    x = cells.join(columns, "column_index").join(beta, ["candidate", "column_index"])
    out = x.groupBy("candidate", "row_index").agg(F.median(F.col("num") - F.col("beta")).alias("alpha"), F.count("num").alias("n"), F.count(F.lit(1)).alias("of"))
    return out.filter(F.col("n") >= required_support(F.col("of"), ratio=ratio)).select("candidate", "row_index", "alpha")


def multiplicative_row_effects(cells: DataFrame, columns: DataFrame, beta: DataFrame, ratio: float = 0.0) -> DataFrame:
    """candidate, row_index, alpha: median of x / beta over columns with a usable beta, two at least and this share of them."""
    x = cells.join(columns, "column_index").join(beta.filter(F.abs("beta") > ZERO), ["candidate", "column_index"])
    out = x.groupBy("candidate", "row_index").agg(F.median(F.col("num") / F.col("beta")).alias("alpha"), F.count("num").alias("n"), F.count(F.lit(1)).alias("of"))
    return out.filter(F.col("n") >= required_support(F.col("of"), ratio=ratio)).select("candidate", "row_index", "alpha")


def additive_step(inside: DataFrame, beta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of alternating medians: row effects centred on 0, then new column parameters."""
    x = inside.filter("num IS NOT NULL").join(beta, ["candidate", "column_index"])
    alpha = x.groupBy("candidate", "row_index").agg(F.median(F.col("num") - F.col("beta")).alias("alpha"))
    centre = alpha.groupBy("candidate").agg(F.median("alpha").alias("centre"))
    alpha = alpha.join(centre, "candidate").select("candidate", "row_index", (F.col("alpha") - F.col("centre")).alias("alpha"))
    new = inside.filter("num IS NOT NULL").join(alpha, ["candidate", "row_index"])
    return alpha, new.groupBy("candidate", "column_index").agg(F.median(F.col("num") - F.col("alpha")).alias("beta"))


def column_medians(inside: DataFrame) -> DataFrame:
    return inside.groupBy("candidate", "column_index").agg(F.median("num").alias("beta"))
