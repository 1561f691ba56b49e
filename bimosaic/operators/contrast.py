"""Contrast of candidates with the rows outside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fit import submatrix
from .prepare import required_support

TIE = 1e-12
_RANGES = 64


def _part(low: int = 0, high: int = _RANGES - 1) -> str:
    """Number of splits below v by bisection, as one SQL expression."""
    mid = (low + high) // 2
    return str(low) if low == high else f"if(v > splits[{mid}], {_part(mid + 1, high)}, {_part(low, mid)})"


def _splits(values: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """keys, splits (approximate percentiles of the distinct v) and the sums asked for, all from one pass."""
    at = F.array(*[F.lit(i / _RANGES) for i in range(1, _RANGES)])
    return values.groupBy(*keys).agg(F.percentile_approx("v", at, F.lit(1000)).alias("splits"), *[c.alias(n) for n, c in sums.items()])


def _counted(points: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """candidate, column_index, counted: sum over probes of w times the number of values below v, those at v counting for side 1 only.

    points (candidate, column_index, v, n, side, w): values have side 0, w 0 and their frequency n; probes have n 0. Points of one
    key are dealt into ranges of v, so that no task sorts a whole column; a range's running count goes on from the ranges below
    it, whose totals are one row a candidate, column and range.
    """
    dealt = points.join(splits.select(*keys, "splits"), keys).withColumn("part", F.expr(_part())).drop("splits")
    running = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0))
    key = ["candidate", "column_index", "part"]
    ranges = dealt.withColumn("running", running).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("running")).alias("s"))
    lower = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rangeBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("lower", F.coalesce(lower, F.lit(0))).groupBy("candidate", "column_index").agg(F.sum(F.col("s") + F.col("w") * F.col("lower")).alias("counted"))


def _auc(n_local: Column, n_all: Column, counted: Column) -> Column:
    """``counted`` holds, for each residual inside, the residuals of all rows below it and those not above it; pairs inside cancel to n^2 / 2."""
    return (n_local * n_all - 0.5 * counted - 0.5 * n_local * n_local) / F.nullif(n_local * (n_all - n_local), F.lit(0))


def flagged(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """All rows of each candidate's columns, ``local`` 1 inside and 0 outside: one left join, one pass."""
    member = rows.withColumn("__in", F.lit(1))
    out = cells.join(columns, "column_index").join(member, ["candidate", "row_index"], "left")
    return out.withColumn("local", F.coalesce("__in", F.lit(0)).cast("long")).drop("__in")


def residual_auc(residuals: DataFrame) -> DataFrame:
    """candidate, column_index, n_local, n_background, outside (rows, with a residual or not), auc from (candidate, column_index, r, local):
    the chance that a residual inside is smaller than one outside, ties within 1e-12 counting half."""
    key = ["candidate", "column_index"]
    v = residuals.groupBy(*key, F.col("r").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("local").alias("w"))
    known = F.col("v").isNotNull()
    splits = _splits(v, key, n_local=F.sum(F.when(known, F.col("w"))), n_all=F.sum(F.when(known, F.col("n"))), outside=F.sum(F.col("n") - F.col("w"))).filter("n_all > 0")
    none = F.lit(0).cast("long")
    point = lambda x, n, side, w: F.struct(x.alias("v"), n.alias("n"), F.lit(side).alias("side"), w.alias("w"))
    own = point(F.col("v"), F.col("n"), 0, none)
    sides = [point(F.col("v") + TIE, none, 1, F.col("w")), point(F.col("v") - TIE, none, -1, F.col("w"))]
    points = v.filter(known).select(*key, F.explode(F.when(F.col("w") > 0, F.array(own, *sides)).otherwise(F.array(own))).alias("p")).select(*key, "p.*")
    out = splits.join(_counted(points, splits, key), key)
    return out.select(*key, "n_local", (F.col("n_all") - F.col("n_local")).alias("n_background"), "outside", _auc(F.col("n_local"), F.col("n_all"), F.col("counted")).alias("auc"))


def constant_contrast_numeric(
    cells: DataFrame, rows: DataFrame, columns: DataFrame, fits: DataFrame, min_background: float = 0.1, inside: DataFrame | None = None
) -> DataFrame:
    """The background is all rows less the members: a residual inside asks its column how many values lie within its distance of the
    parameter, so the work grows with the cells inside candidates and with the table, not with their product. Residuals tie within
    1e-12 or four units in the last place of what they are computed from. ``inside``: the submatrix, where it is at hand."""
    key = ["candidate", "column_index"]
    inside = submatrix(cells, rows, columns) if inside is None else inside
    p = F.col("parameter")
    q = inside.filter("num IS NOT NULL").join(fits.select(*key, "parameter"), key).groupBy(*key, "parameter", F.abs(F.col("num") - p).alias("q")).agg(F.count(F.lit(1)).alias("w"))
    q = q.withColumn("t", F.greatest(F.lit(TIE), (F.abs(p) + F.col("q")) * 2.0**-50))
    probe = lambda v, side, w: F.struct(v.alias("v"), F.lit(side).alias("side"), w.alias("w"))
    w, far, near = F.col("w"), F.col("q") + F.col("t"), F.col("q") - F.col("t")
    sides = [probe(p + far, 1, w), probe(p - far, -1, -w), probe(p + near, -1, w), probe(p - near, 1, -w)]
    none = F.lit(0).cast("long")
    probes = q.select(*key, F.explode(F.when(near > 0, F.array(*sides)).otherwise(F.array(*sides[:2]))).alias("p")).select(*key, "p.v", none.alias("n"), "p.side", "p.w")
    values = cells.groupBy("column_index", F.col("num").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    splits = _splits(values, ["column_index"], n_all=F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), of_all=F.sum("n"))
    points = values.filter("v IS NOT NULL").select(F.lit(None).cast("long").alias("candidate"), "column_index", "v", "n", F.lit(0).alias("side"), none.alias("w"))
    counted = _counted(points.unionByName(probes), splits, ["column_index"]).filter("candidate IS NOT NULL")
    out = inside.groupBy(*key).agg(F.count("num").alias("n_local"), F.count(F.lit(1)).alias("of")).join(counted, key).join(splits.drop("splits"), "column_index")
    enough = F.col("n_all") - F.col("n_local") >= required_support(F.col("of_all") - F.col("of"), ratio=min_background)
    return out.select(*key, F.when(enough, _auc(F.col("n_local"), F.col("n_all"), F.col("counted"))).otherwise(0.0).alias("contrast"), enough.alias("valid"))


def additive_contrast(cells: DataFrame, rows: DataFrame, columns: DataFrame, alpha: DataFrame, beta: DataFrame, min_background: float = 0.1) -> DataFrame:
    """Raw residuals of x - alpha - beta, row effects estimated for all rows."""
    x = flagged(cells, rows, columns).join(alpha, ["candidate", "row_index"]).join(beta, ["candidate", "column_index"])
    x = x.select("candidate", "column_index", F.abs(F.col("num") - F.col("alpha") - F.col("beta")).alias("r"), "local")
    return _gated(residual_auc(x), min_background)


def multiplicative_contrast(cells: DataFrame, rows: DataFrame, columns: DataFrame, alpha: DataFrame, beta: DataFrame, min_background: float = 0.1) -> DataFrame:
    """Residuals of x - alpha * beta in cells brought to their columns' scale (``fit.scaled_cells``), row effects estimated for all rows."""
    x = flagged(cells, rows, columns).join(alpha, ["candidate", "row_index"]).join(beta, ["candidate", "column_index"])
    x = x.select("candidate", "column_index", F.abs(F.col("num") - F.col("alpha") * F.col("beta")).alias("r"), "local")
    return _gated(residual_auc(x), min_background)


def _gated(auc: DataFrame, min_background: float) -> DataFrame:
    """Contrast 0 and an issue where too few rows outside are observed."""
    enough = F.col("n_background") >= required_support(F.col("outside"), ratio=min_background)
    return auc.select("candidate", "column_index", F.when(enough, F.col("auc")).otherwise(0.0).alias("contrast"), enough.alias("valid"))


def constant_contrast_discrete(cells: DataFrame, rows: DataFrame, columns: DataFrame, fits: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """candidate, column_index, inside, outside, contrast, n_outside, of_outside: separation of the mode's frequency inside and outside,
    scaled on either side; half is neutral. What lies outside is the table's counts less those inside, so no row meets a candidate
    it does not belong to."""
    key = ["candidate", "column_index"]
    inside = submatrix(cells, rows, columns) if inside is None else inside
    own = inside.join(fits.select(*key, "mode"), key).groupBy(*key, "mode").agg(
        F.count_if(F.col("code") == F.col("mode")).alias("hits"), F.count("code").alias("n"), F.count(F.lit(1)).alias("of")
    )
    counts = cells.groupBy("column_index", "code").agg(F.count(F.lit(1)).alias("n_code"))
    whole = counts.groupBy("column_index").agg(F.sum(F.when(F.col("code").isNotNull(), F.col("n_code"))).alias("n_all"), F.sum("n_code").alias("of_all"))
    x = own.join(whole, "column_index").join(counts.withColumnRenamed("code", "mode"), ["column_index", "mode"])
    x = x.withColumn("n_outside", F.col("n_all") - F.col("n")).withColumn("of_outside", F.col("of_all") - F.col("of"))
    x = x.select(*key, (F.col("hits") / F.col("n")).alias("inside"), ((F.col("n_code") - F.col("hits")) / F.nullif("n_outside", F.lit(0))).alias("outside"), "n_outside", "of_outside")
    up = F.when(F.col("outside") < 1, 0.5 + 0.5 * (F.col("inside") - F.col("outside")) / (1 - F.col("outside"))).otherwise(0.5)
    down = F.when(F.col("outside") > 0, 0.5 + 0.5 * (F.col("inside") - F.col("outside")) / F.col("outside")).otherwise(0.5)
    contrast = F.when(F.col("outside").isNotNull(), F.when(F.col("inside") >= F.col("outside"), up).otherwise(down))
    return x.select(*key, "inside", "outside", contrast.alias("contrast"), "n_outside", "of_outside")
