"""Evaluation of given biclusters: numeric and discrete columns, any set of patterns, one row a bicluster and one a column.

``evaluate`` fits and assigns patterns (``assignment``), contrasts every column with the rows outside under its own pattern, and sums
up. Whatever cannot be judged scores 0 in contrast or 1 in error and is named as an issue; a bicluster with issues is not valid,
and what is not valid is not feasible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import assignment, contrast, evaluate, fit, joint, prepare
from .assignment import CONSTANT
from .joint import ADDITIVE, MULTIPLICATIVE
from .prepare import required_support

KEY = assignment.KEY
ALL = (CONSTANT, ADDITIVE, MULTIPLICATIVE)
UNASSIGNED, BACKGROUND, LOCAL, STRUCTURE = "PATTERN_UNASSIGNED", "INSUFFICIENT_BACKGROUND", joint.LOCAL, "INVALID_STRUCTURE"


@dataclass
class Evaluations:
    """summary: one row a candidate; columns: one row for each of its columns; effects: row effects of joint groups; issues: candidate, column_index (null: all of it), code."""

    summary: DataFrame
    columns: DataFrame
    effects: DataFrame
    issues: DataFrame


def _joint_contrast(cells: DataFrame, rows: DataFrame, own: DataFrame, sizes: DataFrame, ratio: float, product: bool) -> DataFrame:
    """candidate, column_index, contrast, why of columns (candidate, column_index, parameter) of one joint pattern: row effects for all rows."""
    columns, beta = own.select(*KEY), own.select(*KEY, F.col("parameter").alias("beta"))
    effects = fit.multiplicative_row_effects(cells, columns, beta, ratio) if product else fit.additive_row_effects(cells, columns, beta, ratio)
    x = contrast.flagged(cells, rows, columns).join(effects, ["candidate", "row_index"], "left").join(beta, KEY)
    r = F.abs(F.col("num") - F.col("alpha") * F.col("beta")) if product else F.abs(F.col("num") - F.col("alpha") - F.col("beta"))
    out = contrast.residual_auc(x.select(*KEY, r.alias("r"), "local")).join(sizes.select("candidate", "n_rows"), "candidate")
    local = F.col("n_local") >= required_support(F.col("n_rows"), ratio=ratio)
    outside = F.col("n_background") >= required_support(F.col("outside"), ratio=ratio)
    return out.select(*KEY, F.when(local & outside, F.col("auc")).otherwise(0.0).alias("contrast"), F.when(~local, LOCAL).when(~outside, BACKGROUND).alias("why"))


def column_contrasts(cells: DataFrame, rows: DataFrame, assigned: DataFrame, inside: DataFrame, stats: DataFrame, sizes: DataFrame, patterns: tuple[str, ...], ratio: float) -> DataFrame:
    """candidate, column_index, contrast, why of every column with a pattern; ``assigned`` has candidate, column_index, pattern, parameter, numeric."""
    constant = assigned.filter((F.col("pattern") == CONSTANT))
    numeric, discrete = constant.filter("numeric"), constant.filter("NOT numeric")
    held = lambda x: inside.join(x.select(*KEY), KEY, "left_semi")
    parts = []
    if CONSTANT in patterns:
        found = contrast.constant_contrast_numeric(cells, rows, numeric.select(*KEY), numeric, min_background=ratio, inside=held(numeric))
        parts.append(found.select(*KEY, "contrast", F.when(~F.col("valid"), BACKGROUND).alias("why")))
        modes = discrete.select(*KEY, F.col("parameter").cast("int").alias("mode"))
        found = contrast.constant_contrast_discrete(cells.select("row_index", "column_index", "num", "code"), rows, discrete.select(*KEY), modes, inside=held(discrete))
        enough = (F.col("n_outside") > 0) & (F.col("n_outside") >= required_support(F.col("of_outside"), ratio=ratio))
        parts.append(found.select(*KEY, F.when(enough, F.col("contrast")).otherwise(0.0).alias("contrast"), F.when(~enough, BACKGROUND).alias("why")))
    for p in (ADDITIVE, MULTIPLICATIVE):
        if p in patterns:
            own = assigned.filter(F.col("pattern") == p)
            scaled = fit.scaled_cells(cells, stats) if p == MULTIPLICATIVE else cells
            parts.append(_joint_contrast(scaled, rows, own, sizes, ratio, p == MULTIPLICATIVE))
    return joint.union(parts)


def evaluate_biclusters(
    cells: DataFrame, rows: DataFrame, columns: DataFrame, patterns: tuple[str, ...] = ALL, stats: DataFrame | None = None, frequencies: DataFrame | None = None,
    ratio: float = 0.8, least: int = 2, min_improvement: float = 0.10, min_background: float = 0.10, max_coherence: float = 0.10, size: tuple[float, float] = (0.0, 1.0),
    minimum_rows: int = 2, minimum_columns: int = 2,
) -> Evaluations:
    """Evaluate the biclusters whose members are rows (candidate, row_index) and columns (candidate, column_index).

    ``cells``: row_index, column_index, num (numeric columns), code (discrete ones) and, where values were imputed, observed.
    Candidates below the minimum numbers of rows or columns get their issue and nothing else.
    """
    stats = cut(prepare.column_stats(cells, by_ranges=True) if stats is None else stats, "stats")
    frequencies = prepare.frequencies(cells) if frequencies is None else frequencies
    n = rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_rows")).join(columns.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_columns")), "candidate", "full")
    n = cut(n.fillna(0, ["n_rows", "n_columns"]).withColumn("sound", (F.col("n_rows") >= minimum_rows) & (F.col("n_columns") >= minimum_columns)), "sizes")
    sound = n.filter("sound").select("candidate")
    rows, columns = rows.join(sound, "candidate", "left_semi"), columns.join(sound, "candidate", "left_semi")
    used = cells.join(columns.select("column_index").distinct(), "column_index", "left_semi")
    inside = cut(fit.submatrix(used, rows, columns), "inside")
    constant = fit.constant_fit_numeric(inside, stats, ratio).select(*KEY, "error", "parameter")
    constant = constant.unionByName(fit.constant_fit_discrete(inside, frequencies, ratio).select(*KEY, "error", F.col("mode").cast("double").alias("parameter")))
    found = assignment.assign(inside, stats, constant, patterns, min_improvement, ratio, least)
    is_numeric = inside.groupBy(*KEY).agg((F.count("num") > 0).alias("numeric"))
    assigned = cut(columns.join(found.columns, KEY, "left").join(is_numeric, KEY, "left"), "assigned").fillna(1.0, ["error"])
    contrasts = cut(column_contrasts(used, rows, assigned.filter("pattern IS NOT NULL"), inside, stats, n, patterns, ratio), "contrasts")

    per_column = cells.groupBy("column_index").agg(F.count(F.lit(1)).alias("n"))
    whole = per_column.agg(F.max("n").alias("all_rows"), F.count(F.lit(1)).alias("all_columns"))  # one row
    n = n.crossJoin(F.broadcast(whole))
    background = F.col("all_rows") - F.col("n_rows") >= F.greatest(F.lit(2), F.ceil(min_background * F.col("all_rows")))
    n = n.withColumn("background", background).withColumn("size", evaluate.balanced_size(F.col("n_rows"), F.col("n_columns"), F.col("all_rows"), F.col("all_columns")))
    fewer = evaluate.balanced_size(F.col("n_rows"), F.col("n_columns") - 1, F.col("all_rows"), F.col("all_columns"))
    n = cut(n.withColumn("size_margin", F.col("size") - F.when(F.col("n_columns") > 1, fewer).otherwise(0.0)), "sized")
    detail = assigned.join(contrasts, KEY, "left").join(n.select("candidate", "background", "size_margin"), "candidate")
    value = F.when(F.col("background"), F.coalesce("contrast", F.lit(0.0))).otherwise(0.0)
    why = F.when(F.col("background"), F.when(F.col("pattern").isNull(), F.lit(UNASSIGNED)).otherwise(F.when(F.col("contrast").isNull(), F.lit(LOCAL)).otherwise(F.col("why"))))
    detail = detail.select(*KEY, "pattern", "grp", "error", "parameter", "reference", "margin", "equivalents", "ambiguous", value.alias("contrast"), "size_margin", "reason", why.alias("why"))
    detail = cut(detail, "columns")

    issue = lambda df, code: df.select("candidate", "column_index", code.alias("code"))
    everywhere = F.lit(None).cast("int").alias("column_index")
    issues = issue(detail.filter("reason IS NOT NULL"), F.col("reason")).unionByName(issue(detail.filter("why IS NOT NULL"), F.col("why")))
    issues = issues.unionByName(issue(n.filter("sound AND NOT background").select("candidate", everywhere), F.lit(BACKGROUND)))
    issues = cut(issues.unionByName(issue(n.filter("NOT sound").select("candidate", everywhere), F.lit(STRUCTURE))).distinct(), "issues")
    per = detail.groupBy("candidate").agg(F.least(F.lit(1.0), F.sqrt(F.avg(F.col("error") * F.col("error")))).alias("coherence"), F.avg("contrast").alias("contrast"))
    out = n.join(per, "candidate", "left").join(issues.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_issues")), "candidate", "left").fillna(0, ["n_issues"])
    out = out.withColumn("violation", evaluate.violation(evaluate.coherence_constraint(F.col("coherence"), max_coherence), evaluate.size_constraint(F.col("size"), *size)))
    out = out.withColumn("size", F.when(F.col("sound"), F.col("size"))).withColumn("violation", F.when(F.col("sound"), F.col("violation"))).withColumn("valid", F.col("n_issues") == 0)
    out = out.withColumn("feasible", F.col("valid") & F.coalesce(F.col("violation") <= 0, F.lit(False)))
    return Evaluations(out.select("candidate", "n_rows", "n_columns", "coherence", "contrast", "size", "violation", "n_issues", "valid", "feasible"), detail.drop("why"), found.rows, issues)
