"""Additive and multiplicative fits of many groups of columns at once, in rounds of alternating medians.

A group (grp) is a set of columns of a candidate. Groups of up to ``CELLS_IN_TASK`` cells, whose size is counted first, are fitted
one to a task call on a matrix of that bounded size. For larger groups each round is a few aggregations over the cells of all groups
that still move: row effects from the column parameters, column parameters from the row effects, then how far either moved. What a
round leaves is written to the shared folder, and converged groups leave the rounds. Both ways give the same fits.

Support gates: a column needs ``required_support`` observed cells among the group's rows, before the fit and wherever row effects
are known; a row effect needs as many observed cells among the group's columns. The first column (lowest index) that fails is
rejected with a reason, and the group starts again without it, as long as ``MINIMUM_COLUMNS`` remain.

Where the groups (grp, candidate, column_index) have a ``reference`` error for each column, a fitted group must be worth it: while
a column improves on its reference by less than ``min_improvement``, the worst one (the lowest of equals) leaves and the rest is
fitted again.

``observed`` (boolean, optional) marks cells that were in the source; imputed ones take part in medians but support nothing.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .fit import residual_scale
from .prepare import ZERO, required_support

MINIMUM_COLUMNS = 2
ADDITIVE, MULTIPLICATIVE = "additive", "multiplicative"
#: Reasons for a rejected column.
LOCAL, GROUP, FAILED, PRUNED = "INSUFFICIENT_LOCAL_SUPPORT", "INSUFFICIENT_GROUP_SUPPORT", "PATTERN_FIT_FAILED", "INSUFFICIENT_IMPROVEMENT"
INFINITE = float("inf")
#: A group of more cells is fitted by rounds over all tasks.
CELLS_IN_TASK = 1 << 20
FITTED = "index long, alpha double, beta double, error double, support long, available long, iterations int, converged boolean, reason string"


@dataclass
class JointFits:
    """columns: grp, column_index, beta, error, support, available, iterations, converged; rows: grp, row_index, alpha; rejected: grp, column_index, reason."""

    columns: DataFrame
    rows: DataFrame
    rejected: DataFrame


def group_cells(inside: DataFrame, groups: DataFrame, stats: DataFrame, pattern: str) -> DataFrame:
    """grp, row_index, column_index, v, source, scale: the cells of each group (grp, candidate, column_index); v over the scale for products."""
    known = F.col("num").isNotNull()
    source = (known & F.col("observed") if "observed" in inside.columns else known).cast("int")
    scale = stats.select("column_index", residual_scale(F.col("robust_range"), F.coalesce("median", F.lit(0.0))).alias("scale"))
    v = F.col("num") / F.col("scale") if pattern == MULTIPLICATIVE else F.col("num")
    cells = inside.join(groups, ["candidate", "column_index"]).join(scale, "column_index")
    reference = F.col("reference") if "reference" in groups.columns else F.lit(None).cast("double")  # none: any fit will do
    return cells.select("grp", "row_index", "column_index", v.alias("v"), source.alias("source"), "scale", reference.alias("reference"))


def _gates(cells: DataFrame, ratio: float, least: int) -> DataFrame:
    """grp, column_index, n (cells), required (observed cells that a column needs), scale, reason (null: the column may take part)."""
    per = cells.groupBy("grp", "column_index").agg(F.count(F.lit(1)).alias("n"), F.sum("source").alias("support"), F.count("v").alias("available"), F.max("scale").alias("scale"), F.max("reference").alias("reference"))
    rows = per.groupBy("grp").agg(required_support(F.max("n"), least, ratio).alias("required"))
    reason = F.when(F.col("support") < F.col("required"), LOCAL).when(F.col("available") == 0, FAILED)
    return per.join(rows, "grp").select("grp", "column_index", "n", "required", "scale", "reference", reason.alias("reason"))


def _enough(columns: DataFrame) -> DataFrame:
    """Groups with columns enough for a fit."""
    return columns.join(columns.groupBy("grp").count().filter(F.col("count") >= MINIMUM_COLUMNS).select("grp"), "grp", "left_semi")


def _normal(alpha: DataFrame, beta: DataFrame) -> DataFrame:
    """grp, factor: what divides the row effects so that the median of their sizes is 1 and the first column parameter that counts is positive; null where all vanish."""
    size = alpha.filter(F.abs("a") > ZERO).groupBy("grp").agg(F.median(F.abs("a")).alias("size")).filter(F.col("size") > ZERO)
    first = F.min(F.when(F.abs(F.col("b") * F.col("size")) > ZERO, F.struct("column_index", "b")))
    sign = beta.join(size, "grp").groupBy("grp", "size").agg(first.alias("first"))
    return sign.select("grp", (F.col("size") * F.when(F.col("first.b") < 0, -1.0).otherwise(1.0)).alias("factor"))


def _start_products(cells: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns with beta, rows with alpha for the first round of products, and the groups that have no signal to start from (grp, column_index, reason).

    Row effects start at the column of the widest P05-P95 range (the best filled, then the lowest of equals).
    """
    x = cells.join(columns.select("grp", "column_index"), ["grp", "column_index"]).filter("v IS NOT NULL")
    spread = x.groupBy("grp", "column_index").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.count("v").alias("n"))
    key = F.struct((F.col("p")[1] - F.col("p")[0]).alias("range"), "n", (-F.col("column_index")).alias("place"))
    anchor = spread.groupBy("grp").agg(F.max(key).alias("k")).select("grp", (-F.col("k.place")).alias("column_index"))
    at = cut(x.join(anchor, ["grp", "column_index"]).select("grp", "row_index", "v"), "anchor")
    size = at.filter(F.abs("v") > ZERO).groupBy("grp").agg(F.median(F.abs("v")).alias("size"))
    alpha = cut(at.join(size, "grp").select("grp", "row_index", (F.col("v") / F.col("size")).alias("a")), "start-rows")
    ratio = x.join(alpha.filter(F.abs("a") > ZERO), ["grp", "row_index"]).groupBy("grp", "column_index").agg(F.median(F.col("v") / F.col("a")).alias("b"))
    beta = cut(columns.join(ratio, ["grp", "column_index"], "left"), "start-columns")
    whole = beta.groupBy("grp").agg(F.count_if(F.col("b").isNull()).alias("empty")).filter("empty = 0").select("grp")
    norm = cut(_normal(alpha, beta).join(whole, "grp", "left_semi"), "start-factors")
    none = columns.join(norm, "grp", "left_anti").groupBy("grp").agg(F.min("column_index").alias("column_index")).withColumn("reason", F.lit(FAILED))
    beta = beta.join(norm, "grp").select(*columns.columns, (F.col("b") * F.col("factor")).alias("beta"))
    n = alpha.groupBy("grp").agg(F.count(F.lit(1)).alias("n_was"))
    rows = alpha.join(norm, "grp").join(n, "grp").select("grp", "row_index", (F.col("a") / F.col("factor")).alias("alpha"), "n_was")
    return beta, rows, none


def _row_effects(x: DataFrame, pattern: str, ratio: float, least: int) -> DataFrame:
    """grp, row_index, a from cells with beta and width (the columns that may support a row)."""
    usable = F.abs("beta") > ZERO if pattern == MULTIPLICATIVE else F.lit(True)
    residual = F.col("v") / F.col("beta") if pattern == MULTIPLICATIVE else F.col("v") - F.col("beta")
    x = x.filter(F.col("v").isNotNull() & usable)
    a = x.groupBy("grp", "row_index").agg(F.median(residual).alias("a"), F.sum("source").alias("support"), F.first("width").alias("width"))
    enough = F.col("support") >= required_support(F.col("width"), least, ratio)
    return a.filter(enough & ((F.col("width") >= 2) if pattern == MULTIPLICATIVE else F.lit(True))).select("grp", "row_index", "a")


def _round(cells: DataFrame, beta: DataFrame, alpha: DataFrame | None, pattern: str, ratio: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: rows (grp, row_index, alpha, n_was: how many), columns (those of ``beta`` with the new beta), verdict (grp, moved, rejected, reason)."""
    product = pattern == MULTIPLICATIVE
    usable = F.when(F.abs("beta") > ZERO, 1) if product else F.lit(1)
    width = beta.groupBy("grp").agg(F.count(usable).alias("width"))
    x = cells.join(beta.join(width, "grp").select("grp", "column_index", "beta", "width"), ["grp", "column_index"])
    raw = _row_effects(x, pattern, ratio, least)
    if alpha is not None:
        raw = raw.join(alpha, ["grp", "row_index"], "left")
    else:
        raw = raw.withColumns({"alpha": F.lit(None).cast("double"), "n_was": F.lit(0).cast("long")})
    raw = cut(raw.withColumnRenamed("alpha", "was"), "row-effects")
    known = cells.filter("v IS NOT NULL").join(raw.filter(F.abs("a") > ZERO) if product else raw, ["grp", "row_index"])
    b = F.median(F.col("v") / F.col("a") if product else F.col("v") - F.col("a"))
    columns = beta.join(known.groupBy("grp", "column_index").agg(b.alias("b"), F.sum("source").alias("met")), ["grp", "column_index"], "left")
    columns = cut(columns, "column-effects")
    short = F.min(F.when(F.coalesce("met", F.lit(0)) < F.col("required"), F.col("column_index")))
    per = columns.groupBy("grp").agg(short.alias("rejected"), F.min("column_index").alias("lowest"), F.median("scale").alias("unit"))
    if product:
        level = _normal(raw, columns.filter("b IS NOT NULL"))
        new_a, new_b = F.col("a") / F.col("factor"), F.col("b") * F.col("factor")
    else:
        level = raw.groupBy("grp").agg(F.median("a").alias("factor"))
        new_a, new_b = F.col("a") - F.col("factor"), F.col("b") + F.col("factor")
    level = per.join(level, "grp", "left")
    lost = F.col("rejected").isNull() & F.col("factor").isNull()  # every row effect vanished
    level = level.withColumn("reason", F.when(F.col("rejected").isNotNull(), GROUP).when(lost, FAILED)).withColumn("rejected", F.when(lost, F.col("lowest")).otherwise(F.col("rejected")))
    factor = level.filter("rejected IS NULL").select("grp", "factor")
    off = raw.join(factor, "grp").groupBy("grp").agg(F.max(F.abs(new_a - F.col("was"))).alias("rows_off"), F.count(F.lit(1)).alias("n"), F.count("was").alias("both"), F.max("n_was").alias("n_was"))
    off = off.join(columns.join(factor, "grp").groupBy("grp").agg(F.max(F.abs(new_b - F.col("beta"))).alias("columns_off")), "grp")
    same = (F.col("n") == F.col("both")) & (F.col("n") == F.col("n_was"))
    moved = F.when(same, F.greatest("rows_off", "columns_off")).otherwise(INFINITE) / (F.lit(1.0) if product else F.col("unit"))
    verdict = cut(level.join(off, "grp", "left").select("grp", "factor", "rejected", "reason", "n", moved.alias("moved")), "verdict")
    going = verdict.filter("rejected IS NULL").select("grp", "factor", "n")
    rows = raw.join(going, "grp").select("grp", "row_index", new_a.alias("alpha"), F.col("n").alias("n_was"))
    columns = columns.join(going, "grp").select("grp", "column_index", "required", "scale", new_b.alias("beta"))
    return rows, columns, verdict


def _median(x: np.ndarray, axis: int) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nanmedian(x, axis)


def _normalised(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    sizes = np.abs(a[np.abs(a) > ZERO])  # False for NaN
    if not len(sizes):
        return None
    factor = np.median(sizes)
    first = b[np.abs(b * factor) > ZERO][:1]
    factor = -factor if len(first) and first[0] < 0 else factor
    return a / factor, b * factor


class Matrix:
    """One group as a matrix: v (NaN: missing), seen (observed cells), scale and number of each column."""

    def __init__(self, v: np.ndarray, seen: np.ndarray, scale: np.ndarray, names: np.ndarray, pattern: str, ratio: float, least: int):
        self.v, self.seen, self.scale, self.names, self.product = v, seen, scale, names, pattern == MULTIPLICATIVE
        self.need = lambda n: max(least, math.ceil(n * ratio))
        self.by_row = self.need(len(v))

    def start(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.product:
            return np.full(len(self.v), np.nan), _median(self.v, 0)
        low, high = np.nanpercentile(self.v, [5, 95], axis=0)
        anchor = max(range(len(self.names)), key=lambda j: (high[j] - low[j], np.isfinite(self.v[:, j]).sum(), -j))
        a = self.v[:, anchor]
        if not (np.abs(a) > ZERO).any():
            return None
        a = a / np.median(np.abs(a[np.abs(a) > ZERO]))
        b = self.columns(a)[0]
        return None if np.isnan(b).any() else _normalised(a, b)

    def columns(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column parameters from row effects, and the observed cells behind each."""
        rows = np.abs(a) > ZERO if self.product else np.isfinite(a)
        v, a = self.v[rows], a[rows, None]
        met = (self.seen[rows] & np.isfinite(v)).sum(0)
        return _median(v / a if self.product else v - a, 0) if rows.any() else np.full(len(self.names), np.nan), met

    def rows(self, b: np.ndarray) -> np.ndarray:
        """Row effects from column parameters, NaN where too few cells are observed."""
        use = np.abs(b) > ZERO if self.product else np.ones(len(b), bool)
        if self.product and use.sum() < 2:
            return np.full(len(self.v), np.nan)
        v = self.v[:, use]
        a = _median(v / b[use] if self.product else v - b[use], 1)
        return np.where((self.seen[:, use] & np.isfinite(v)).sum(1) >= self.need(use.sum()), a, np.nan)

    def rejected(self, met: np.ndarray, reason: str) -> tuple[int, str] | None:
        short = np.flatnonzero(met < self.by_row)
        return (int(self.names[short[0]]), reason) if len(short) else None

    def fit(self, iterations: int, tolerance: float) -> tuple[int, str] | tuple[np.ndarray, np.ndarray, int, bool]:
        """A rejected column and why, or alpha, beta, rounds and whether they converged."""
        started = self.start()
        if started is None:
            return int(self.names[0]), FAILED
        (alpha, beta), unit = started, 1.0 if self.product else float(np.median(self.scale))
        for k in range(1, iterations + 1):
            a = self.rows(beta)
            b, met = self.columns(a)
            if (out := self.rejected(met, GROUP)) is not None:
                return out
            if self.product:
                normal = _normalised(a, b)
                if normal is None:
                    return int(self.names[0]), FAILED
                a, b = normal
            else:
                centre = np.nanmedian(a)
                a, b = a - centre, b + centre
            same = (np.isfinite(a) == np.isfinite(alpha)).all()
            moved = max(np.nanmax(np.abs(a - alpha)) if same else INFINITE, np.abs(b - beta).max()) / unit
            alpha, beta = a, b
            if moved <= tolerance:
                break
        return alpha, beta, k, bool(moved <= tolerance)


def _fit_in_task(cells: DataFrame, columns: DataFrame, pattern: str, ratio: float, least: int, iterations: int, tolerance: float, min_improvement: float) -> DataFrame:
    """grp and FITTED: rows (alpha), columns (beta) and rejections (reason) of groups of bounded size."""
    kind = dict(cells.dtypes)["grp"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        get = lambda c: t[c].to_numpy()
        row, i = np.unique(get("row_index"), return_inverse=True)
        names, j = np.unique(get("column_index"), return_inverse=True)
        v, seen, scale, reference = np.full((len(row), len(names)), np.nan), np.zeros((len(row), len(names)), bool), *np.empty((2, len(names)))
        v[i, j], seen[i, j], scale[j], reference[j] = get("v"), get("source") > 0, get("scale"), get("reference")
        out: list[tuple] = []
        at = np.arange(len(names))
        while len(at) >= MINIMUM_COLUMNS:
            m = Matrix(v[:, at], seen[:, at], scale[at], names[at], pattern, ratio, least)
            found = m.fit(iterations, tolerance)
            if len(found) == 2:
                out.append((found[0], None, None, None, None, None, None, None, found[1]))
                at = at[names[at] != found[0]]
                continue
            alpha, beta, k, converged = found
            off = np.abs(m.v - alpha[:, None] * beta) if m.product else np.abs(m.v - alpha[:, None] - beta) / m.scale
            known = np.isfinite(off)
            error = np.where(known, np.minimum(1.0, off), 0).sum(0) / known.sum(0)
            deficit = np.nan_to_num(min_improvement - (reference[at] - error), nan=-1.0)
            if deficit.max() > 0:
                worst = names[at[deficit.argmax()]]
                out.append((int(worst), *[None] * 7, PRUNED))
                at = at[names[at] != worst]
                continue
            out += [(int(row[x]), float(alpha[x]), *[None] * 7) for x in np.flatnonzero(np.isfinite(alpha))]
            out += [(int(names[c]), None, float(beta[x]), float(min(1.0, error[x])), int((known & m.seen)[:, x].sum()), int(known[:, x].sum()), k, converged, None) for x, c in enumerate(at)]
            break
        types = (pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        arrays = [pa.array(x, t_) for x, t_ in zip(zip(*out), types)] if out else [pa.array([], t_) for t_ in types]
        return pa.table([pa.array([key[0].as_py()] * len(out), t.schema.field("grp").type), *arrays], names=["grp", *[c.split()[0] for c in FITTED.split(", ")]])

    return cells.join(columns.select("grp", "column_index"), ["grp", "column_index"], "left_semi").groupBy("grp").applyInArrow(run, f"grp {kind}, {FITTED}")


def fit_groups(
    inside: DataFrame, groups: DataFrame, stats: DataFrame, pattern: str, ratio: float = 0.8, least: int = 2, iterations: int = 25, tolerance: float = 1e-6, min_improvement: float = 0.10
) -> JointFits:
    """Fit every group (grp, candidate, column_index) of the submatrices ``inside`` (candidate, row_index, column_index, num)."""
    cells = cut(group_cells(inside, groups, stats, pattern), "group-cells")
    gates = cut(_gates(cells, ratio, least), "gates")
    rejected = gates.filter("reason IS NOT NULL").select("grp", F.col("column_index").cast("long").alias("column_index"), "reason")
    columns = _enough(gates.filter("reason IS NULL"))
    columns = cut(columns.join(columns.groupBy("grp").agg((F.sum("n") > CELLS_IN_TASK).alias("large")), "grp").drop("reason", "n"), "columns")
    small = cut(_fit_in_task(cells, columns.filter("NOT large"), pattern, ratio, least, iterations, tolerance, min_improvement), "fits-in-tasks")
    fits = small.filter("beta IS NOT NULL").select("grp", F.col("index").cast("int").alias("column_index"), "beta", "error", "support", "available", "iterations", "converged")
    rows = small.filter("alpha IS NOT NULL").select("grp", F.col("index").alias("row_index"), "alpha")
    rejected = rejected.unionByName(small.filter("reason IS NOT NULL").select("grp", F.col("index").alias("column_index"), "reason"))
    large = columns.filter("large").drop("large")
    while not large.isEmpty():
        more = _fit_in_rounds(cells, large, pattern, ratio, least, iterations, tolerance)
        deficit = F.min_by("column_index", F.struct(-(min_improvement - (F.col("reference") - F.col("error"))), "column_index"))
        short = more.columns.join(large.filter("reference IS NOT NULL").select("grp", "column_index", "reference"), ["grp", "column_index"])
        short = cut(short.filter(F.lit(min_improvement) - (F.col("reference") - F.col("error")) > 0).groupBy("grp").agg(deficit.alias("column_index")), "pruned")
        held = lambda x: x.join(short.select("grp"), "grp", "left_anti")
        fits, rows = fits.unionByName(held(more.columns)), rows.unionByName(held(more.rows))
        rejected = rejected.unionByName(more.rejected).unionByName(short.withColumn("reason", F.lit(PRUNED)))
        gone = short.unionByName(more.rejected.select("grp", "column_index"))
        large = cut(_enough(large.join(short.select("grp"), "grp", "left_semi").join(gone, ["grp", "column_index"], "left_anti")), "columns")
    return JointFits(fits, rows, rejected.withColumn("column_index", F.col("column_index").cast("int")))


def _fit_in_rounds(cells: DataFrame, columns: DataFrame, pattern: str, ratio: float, least: int, iterations: int, tolerance: float) -> JointFits:
    """The same by rounds over the cells of all groups of ``columns``."""
    done_columns, done_rows, rejected = [], [], [columns.limit(0).select("grp", "column_index", F.lit("").alias("reason"))]
    while not columns.isEmpty():  # a wave: all groups that start (again)
        alpha, out = None, []
        if pattern == MULTIPLICATIVE:
            beta, alpha, none = _start_products(cells, columns)
            out.append(none)
        else:
            middle = cells.join(columns.select("grp", "column_index"), ["grp", "column_index"]).groupBy("grp", "column_index").agg(F.median("v").alias("beta"))
            beta = columns.join(middle, ["grp", "column_index"])
        beta = cut(beta, "columns")
        for k in range(1, iterations + 1):
            alpha, beta, verdict = _round(cells, beta, alpha, pattern, ratio, least)
            out.append(verdict.filter("rejected IS NOT NULL").select("grp", F.col("rejected").alias("column_index"), "reason"))
            still = F.col("moved") <= tolerance
            ended = verdict.filter(F.col("rejected").isNull() & (still if k < iterations else F.lit(True))).select("grp", still.alias("converged"))
            done_columns.append(beta.join(ended, "grp").select("grp", "column_index", "beta", F.lit(k).alias("iterations"), "converged"))
            done_rows.append(alpha.drop("n_was").join(ended, "grp", "left_semi"))
            going = verdict.filter(F.col("rejected").isNull() & ~still).select("grp")
            if k == iterations or going.isEmpty():
                break
            alpha, beta = alpha.join(going, "grp", "left_semi"), beta.join(going, "grp", "left_semi")
        gone = cut(union(out), "rejected")
        rejected.append(gone)
        again = columns.join(gone.select("grp"), "grp", "left_semi").join(gone.select("grp", "column_index"), ["grp", "column_index"], "left_anti")
        columns = cut(_enough(again), "columns")
    beta, alpha = cut(union(done_columns), "fitted-columns"), cut(union(done_rows), "fitted-rows")
    x = cells.filter("v IS NOT NULL").join(alpha, ["grp", "row_index"]).join(beta, ["grp", "column_index"])
    off = F.abs(F.col("v") - F.col("alpha") * F.col("beta")) if pattern == MULTIPLICATIVE else F.abs(F.col("v") - F.col("alpha") - F.col("beta")) / F.col("scale")
    per = x.groupBy("grp", "column_index", "beta", "iterations", "converged").agg(
        F.least(F.lit(1.0), F.avg(F.least(F.lit(1.0), off))).alias("error"), F.sum("source").alias("support"), F.count(F.lit(1)).alias("available")
    )
    per = per.select("grp", "column_index", "beta", "error", "support", "available", "iterations", "converged")
    return JointFits(cut(per, "joint-fits"), alpha, cut(union(rejected), "rejected"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def joint_fit(inside: DataFrame, stats: DataFrame, pattern: str, ratio: float = 0.8) -> DataFrame:
    """candidate, column_index, beta, error, support, iterations, converged: all columns of each candidate as one group."""
    groups = inside.select("candidate", "column_index").distinct().withColumn("grp", F.col("candidate"))
    return fit_groups(inside, groups, stats, pattern, ratio).columns.withColumnRenamed("grp", "candidate").drop("available")

