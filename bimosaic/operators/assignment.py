"""Which pattern each column of a candidate follows, for all candidates at once.

Constant fits are local: each column has its own. Additive and multiplicative models are joint: at most one group of columns of each
per candidate. Column groups are proposed (``grouping``), fitted (``joint``), and each pattern's best proposal enters. Where both
joint patterns may be used they compete: of all their subsets the one wins whose columns, each with its best pattern, improve most
on their references (then more columns, fewer patterns, the first by name), each pattern with two columns at least. The groups that
result are fitted again on their own columns; with a constant pattern to fall back on, columns that do not improve by
``min_improvement`` leave one by one, worst first. Without one, a lack of improvement counts as error.

The reference of a column is its constant fit; columns without a valid one join no group.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import grouping, joint
from .joint import ADDITIVE, MULTIPLICATIVE
from .search import evidence_deficit, model_margins

CONSTANT = "constant"
KEY = ["candidate", "column_index"]
COLUMNS = "candidate long, column_index int, pattern string, grp string, error double, parameter double, reference double, margin double, equivalents string, ambiguous boolean, reason string"


@dataclass
class Assignment:
    """columns: one row for each column of each candidate (COLUMNS; pattern null: none, error 1); rows: candidate, pattern, row_index, alpha."""

    columns: DataFrame
    rows: DataFrame


def proposed(inside: DataFrame, stats: DataFrame, pattern: str) -> DataFrame:
    """candidate, columns, discovered: column groups worth a fit; all columns where the anchors propose none."""
    profiles = grouping.additive_profiles(inside, stats) if pattern == ADDITIVE else grouping.multiplicative_profiles(inside, stats)
    found = cut(grouping.proposals(grouping.anchor_distances(profiles, either_sign=pattern == MULTIPLICATIVE)).withColumn("discovered", F.lit(True)), "proposals")
    whole = inside.select(*KEY).distinct().groupBy("candidate").agg(F.array_sort(F.collect_list("column_index")).alias("columns")).filter(F.size("columns") >= joint.MINIMUM_COLUMNS)
    return found.unionByName(whole.join(found.select("candidate").distinct(), "candidate", "left_anti").withColumn("discovered", F.lit(False)))


def best_proposals(inside: DataFrame, stats: DataFrame, references: DataFrame, pattern: str, evidence: bool, options: dict, min_improvement: float) -> DataFrame:
    """candidate, pattern, column_index, error, reference, beta of each candidate's best proposal of one pattern: by total improvement, columns, mean error.

    ``evidence``: proposals are pruned until every column improves enough; otherwise only those are that were not discovered.
    """
    groups = cut(proposed(inside, stats, pattern).withColumn("grp", F.monotonically_increasing_id()), "numbered")
    members = groups.select("grp", "candidate", "discovered", F.explode("columns").alias("column_index")).join(references, KEY)
    if not evidence:
        members = members.withColumn("reference", F.when(~F.col("discovered"), F.col("reference")))
    fits = joint.fit_groups(inside, members.select("grp", *KEY, "reference"), stats, pattern, min_improvement=min_improvement, **options).columns
    fits = cut(fits.select("grp", "column_index", "error", "beta").join(groups.select("grp", "candidate"), "grp").join(references, KEY), "proposal-fits")
    gain = F.col("reference") - F.col("error")
    key = F.struct((-F.sum(gain)).alias("a"), (-F.count(F.lit(1))).alias("b"), F.avg("error").alias("c"), F.array_sort(F.collect_list("column_index")).alias("d"), F.col("grp").alias("e"))
    best = fits.groupBy("candidate", "grp").agg(key.alias("k")).groupBy("candidate").agg(F.min("k").alias("k")).select("candidate", F.col("k.e").alias("grp"))
    return cut(fits.join(best, ["candidate", "grp"]).select("candidate", F.lit(pattern).alias("pattern"), "column_index", "error", "reference", "beta"), "best-proposals")


def chosen_subset(proposals: DataFrame, patterns: list[str], min_improvement: float, fallback: bool) -> DataFrame:
    """candidate, pattern, column_index: the columns of the subset of patterns that explains most; proposals: candidate, pattern, column_index, error, reference."""
    subsets = [list(c) for k in range(1, len(patterns) + 1) for c in combinations(sorted(patterns), k)]
    gain = F.col("reference") - F.col("error")
    rows = proposals.filter(gain >= min_improvement) if fallback else proposals
    of = F.explode(F.array(*[F.struct(F.lit(i).alias("subset"), F.array(*map(F.lit, s)).alias("names")) for i, s in enumerate(subsets)])).alias("s")
    rows = rows.select("*", of).filter(F.array_contains("s.names", F.col("pattern")))
    choice = rows.groupBy(*KEY, "s").agg(F.min(F.struct("error", "pattern", gain.alias("gain"))).alias("c"))
    per = choice.groupBy("candidate", "s", F.col("c.pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.sum("c.gain").alias("gain"))
    per = per.filter(F.col("n") >= joint.MINIMUM_COLUMNS).groupBy("candidate", "s").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    per = per.filter(F.col("patterns") == F.size("s.names"))  # a pattern with too few columns rules its subset out
    key = F.struct((-F.round("gain", 12)).alias("a"), (-F.col("n")).alias("b"), F.size("s.names").alias("c"), F.col("s.names").alias("d"), "s")
    best = per.groupBy("candidate").agg(F.min(key).alias("k")).select("candidate", F.col("k.s").alias("s"))
    return choice.join(best, ["candidate", "s"]).select("candidate", F.col("c.pattern").alias("pattern"), "column_index")


def assign(
    inside: DataFrame, stats: DataFrame, constant_fits: DataFrame, patterns: tuple[str, ...] = (CONSTANT, ADDITIVE, MULTIPLICATIVE),
    min_improvement: float = 0.10, ratio: float = 0.8, least: int = 2, iterations: int = 25, tolerance: float = 1e-6,
) -> Assignment:
    """Patterns of the columns of all candidates.

    ``inside``: candidate, row_index, column_index, num, code (and observed); ``constant_fits``: candidate, column_index, error,
    parameter of numeric and discrete columns whose constant fit is valid.
    """
    spark = inside.sparkSession
    options = {"ratio": ratio, "least": least, "iterations": iterations, "tolerance": tolerance}
    names, fallback = [p for p in (ADDITIVE, MULTIPLICATIVE) if p in patterns], CONSTANT in patterns
    every = cut(inside.groupBy(*KEY).agg(F.count("num").alias("numeric")), "assigned-columns")
    constant_fits = cut(constant_fits.select(*KEY, F.col("error").cast("double").alias("error"), F.col("parameter").cast("double").alias("parameter")), "constant-fits")
    references = cut(constant_fits.join(every.filter("numeric > 0").select(*KEY), KEY).select(*KEY, F.col("error").alias("reference")), "references")
    eligible = inside.join(references.select(*KEY), KEY, "left_semi") if names else inside

    proposals = members = None
    if len(names) == 1 and not fallback:
        members = references.select("candidate", F.lit(names[0]).alias("pattern"), "column_index")
    elif names:
        eligible = cut(eligible, "eligible")
        parts = [best_proposals(eligible, stats, references, p, fallback and len(names) == 1, options, min_improvement) for p in names]
        proposals = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        members = proposals.select("candidate", "pattern", "column_index") if len(names) == 1 else cut(chosen_subset(proposals, names, min_improvement, fallback), "chosen")

    fitted, rows, failures = [], [], []
    for p in names:
        groups = members.filter(F.col("pattern") == p).join(references, KEY).withColumn("grp", F.col("candidate"))
        groups = groups.select("grp", *KEY, "reference") if fallback else groups.select("grp", *KEY)
        found = joint.fit_groups(eligible, groups, stats, p, min_improvement=min_improvement, **options)
        fitted.append(found.columns.select(F.col("grp").alias("candidate"), "column_index", F.lit(p).alias("pattern"), "error", F.col("beta").alias("parameter")))
        rows.append(found.rows.select(F.col("grp").alias("candidate"), F.lit(p).alias("pattern"), "row_index", "alpha"))
        failures.append(found.rejected.select(F.col("grp").alias("candidate"), "column_index", "reason"))
    local = constant_fits.withColumn("pattern", F.lit(CONSTANT))
    if not names:
        columns = every.select(*KEY).join(local, KEY, "left").join(references, KEY, "left")
        reason = F.when(F.col("pattern").isNull(), joint.LOCAL)
        columns = columns.select(*KEY, "pattern", F.lit(None).cast("string").alias("grp"), F.coalesce("error", F.lit(1.0)).alias("error"), "parameter", "reference",
                                 F.lit(None).cast("double").alias("margin"), F.lit(None).cast("string").alias("equivalents"), F.lit(False).alias("ambiguous"), reason.alias("reason"))
        return Assignment(columns, spark.createDataFrame([], "candidate long, pattern string, row_index long, alpha double"))

    committed = joint.union(fitted).join(references, KEY)
    if not fallback:
        committed = committed.withColumn("error", evidence_deficit(F.col("error"), F.col("reference"), min_improvement))
    committed = cut(committed, "committed")
    owned = committed.select(*KEY, "pattern", "error", "parameter").withColumn("grp", F.concat("pattern", F.lit("-0")))
    if fallback:
        owned = owned.unionByName(local.join(committed.select(*KEY), KEY, "left_anti").withColumn("grp", F.lit(None).cast("string")))
    owned = cut(owned, "owned")
    alternatives = committed.select(*KEY, "pattern", "error")
    if proposals is not None:
        alternatives = alternatives.unionByName(proposals.join(committed.select(*KEY, "pattern"), [*KEY, "pattern"], "left_anti").select(*KEY, "pattern", "error"))
    if fallback:
        alternatives = alternatives.unionByName(local.select(*KEY, "pattern", "error"))
    marked = alternatives.join(owned.select(*KEY, F.col("pattern").alias("own")), KEY).select(*KEY, "pattern", "error", (F.col("pattern") == F.col("own")).alias("chosen"))
    margins = model_margins(cut(marked, "alternatives"))
    why = joint.union(failures).filter(F.col("reason") != joint.PRUNED).groupBy(*KEY).agg(F.min("reason").alias("why"))
    out = every.select(*KEY).join(owned, KEY, "left").join(references, KEY, "left").join(margins, KEY, "left").join(why, KEY, "left")
    reason = F.when(F.col("pattern").isNull(), F.coalesce("why", F.when(F.col("reference").isNull(), joint.LOCAL).otherwise("PATTERN_UNASSIGNED")))
    out = out.select(*KEY, "pattern", "grp", F.coalesce("error", F.lit(1.0)).alias("error"), "parameter", "reference", "margin", "equivalents", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), reason.alias("reason"))
    return Assignment(cut(out, "assignment"), joint.union(rows).join(committed.select("candidate", "pattern").distinct(), ["candidate", "pattern"], "left_semi"))
