"""Column profiles and the missing-value, column and scaling stages, over long cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ZERO = 1e-12


#: Distinct values of a group that one task sorts, about.
IN_RANGE = 50_000


def exact_percentiles(values: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """keys, n, p (array): the exact percentiles of each group, interpolated, without a group's values ever meeting in one task.

    Equal values are counted first; the distinct ones are dealt into ranges by approximate percentiles, as many ranges as the largest
    group needs; a value's ranks are its range's start, from the totals of the ranges below, and a running count inside the range.
    """
    counts = cut(values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")), "value-counts")
    widest = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-widest // IN_RANGE))
    cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
    splits = F.percentile_approx("__v", cuts, F.lit(max(1000, 10 * parts))) if parts > 1 else F.array().cast("array<double>")
    per = counts.groupBy(*keys).agg(F.sum("__n").alias("n"), splits.alias("__splits") if parts > 1 else F.first(splits).alias("__splits"))
    part = F.size(F.filter("__splits", lambda s: s < F.col("__v")))
    dealt = counts.join(per, keys).withColumn("__part", part).drop("__splits")
    totals = dealt.groupBy(*keys, "__part").agg(F.sum("__n").alias("__total"))
    below = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "__part", F.coalesce(below, F.lit(0)).alias("__below"))
    running = F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    x = dealt.withColumn("__running", running).join(totals, [*keys, "__part"]).withColumn("__upto", F.col("__below") + F.col("__running"))
    index = lambda q: (F.col("n") - 1) * F.lit(float(q))
    here = lambda i: F.when((F.col("__upto") - F.col("__n") <= i) & (i < F.col("__upto")), F.col("__v"))
    ends = [e for k, q in enumerate(at) for e in (F.max(here(F.floor(index(q)))).alias(f"__low{k}"), F.max(here(F.ceil(index(q)))).alias(f"__high{k}"))]
    found = x.groupBy(*keys, "n").agg(*ends)
    between = [F.col(f"__low{k}") + (F.col(f"__high{k}") - F.col(f"__low{k}")) * (index(q) - F.floor(index(q))) for k, q in enumerate(at)]
    return found.select(*keys, "n", F.array(*between).alias("p"))


def column_stats(cells: DataFrame, by_ranges: bool = False) -> DataFrame:
    """column_index, n, p05, median, p95, robust_range, zero_scale of numeric columns (linear interpolation, exact).

    ``by_ranges``: for tables whose columns' distinct values do not fit one task (``exact_percentiles``); the figures are the same.
    """
    at = [0.05, 0.5, 0.95]
    if by_ranges:
        found = exact_percentiles(cells, ["column_index"], "num", at)
        p = cells.select("column_index").distinct().join(found, "column_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        p = cells.groupBy("column_index").agg(F.count("num").alias("n"), F.percentile("num", F.array(*map(F.lit, at))).alias("p"))
    out = p.select("column_index", "n", F.col("p")[0].alias("p05"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p95"))
    out = out.withColumn("robust_range", F.col("p95") - F.col("p05"))
    return out.withColumn("zero_scale", F.coalesce(F.col("robust_range") <= ZERO, F.lit(False)))


def mode_codes(cells: DataFrame) -> DataFrame:
    """column_index, mode: the most frequent code, the lowest of equally frequent ones."""
    counts = cells.filter("code IS NOT NULL").groupBy("column_index", "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_index").agg(F.max(F.struct("n", (-F.col("code")).alias("m"))).alias("top")).select("column_index", (-F.col("top.m")).alias("mode"))


def impute_median_mode(cells: DataFrame) -> DataFrame:
    """Cells with ``available`` values: medians and modes in place of nulls; ``observed`` keeps what was there."""
    medians = cells.filter("num IS NOT NULL").groupBy("column_index").agg(F.median("num").alias("__median"))
    out = cells.join(medians, "column_index", "left").join(mode_codes(cells).withColumnRenamed("mode", "__mode"), "column_index", "left")
    observed = F.col("num").isNotNull() | F.col("code").isNotNull()
    out = out.withColumn("observed", observed).withColumn("available", observed | F.col("__median").isNotNull() | F.col("__mode").isNotNull())
    return out.withColumn("num", F.coalesce("num", "__median")).withColumn("code", F.coalesce("code", "__mode")).drop("__median", "__mode")


def missing_counts(cells: DataFrame) -> DataFrame:
    """column_index, n_rows, n_missing, missing_ratio."""
    missing = F.col("num").isNull() & F.col("code").isNull()
    out = cells.groupBy("column_index").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_missing"))
    return out.withColumn("missing_ratio", F.col("n_missing") / F.col("n_rows"))


def reject_missing(cells: DataFrame) -> DataFrame:
    missing = F.col("num").isNull() & F.col("code").isNull()
    return cells.filter(F.when(missing, F.raise_error(F.lit("missing value"))).otherwise(F.lit(True)))


def missingness_indicators(cells: DataFrame, first_index: int, min_ratio: float = 0.1, max_ratio: float = 1.0) -> DataFrame:
    """Cells of derived boolean columns (code 1 where the source is missing), numbered from ``first_index`` in source order."""
    pick = missing_counts(cells).filter((F.col("missing_ratio") >= min_ratio) & (F.col("missing_ratio") <= max_ratio) & (F.col("n_missing") > 0))
    pick = pick.select("column_index", (F.row_number().over(Window.orderBy("column_index")) - 1 + first_index).cast("int").alias("__new"))
    flag = (F.col("num").isNull() & F.col("code").isNull()).cast("int")
    out = cells.join(pick, "column_index")
    return out.select("row_index", F.col("__new").alias("column_index"), F.lit(None).cast("double").alias("num"), flag.alias("code"), F.col("column_index").alias("source_column_index"))


def drop_all_missing(cells: DataFrame) -> DataFrame:
    """Columns with an observed value, renumbered from 0; the old number in source_column_index."""
    seen = missing_counts(cells).filter("n_missing < n_rows")
    seen = seen.select("column_index", (F.row_number().over(Window.orderBy("column_index")) - 1).cast("int").alias("__new"))
    out = cells.join(seen, "column_index")
    return out.withColumn("source_column_index", F.col("column_index")).withColumn("column_index", F.col("__new")).drop("__new")


def robust_scale(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - median) / range; where the range is zero, 0 for the median and otherwise the sign of the deviation."""
    s = stats.select("column_index", "median", "robust_range", "zero_scale")
    d = F.col("num") - F.col("median")
    scaled = F.when(~F.col("zero_scale"), d / F.col("robust_range")).when(F.abs(d) <= ZERO, 0.0).otherwise(F.signum(d))
    out = cells.join(s, "column_index", "left").withColumn("num", F.when(F.col("num").isNotNull(), scaled))
    return out.drop("median", "robust_range", "zero_scale")


def frequencies(cells: DataFrame) -> DataFrame:
    """column_index, code, n, frequency, cardinality of discrete columns."""
    counts = cells.filter("code IS NOT NULL").groupBy("column_index", "code").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("column_index")
    return counts.select("column_index", "code", "n", (F.col("n") / F.sum("n").over(whole)).alias("frequency"), F.count(F.lit(1)).over(whole).alias("cardinality"))


def required_support(n, min_count: int = 2, ratio: float = 0.8):
    """Observations that n possible ones need."""
    return F.greatest(F.lit(min_count), F.ceil(n * F.lit(ratio))).cast("long")
