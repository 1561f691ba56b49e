"""Agreement of bicluster sets with each other, with perturbed controls and with annotations; nested sets cut down to the largest good ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .seeds import draw


def pattern_concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, concordance: of the columns two biclusters share, the part with the same pattern; (id, column_index, pattern)."""
    x = a.select(F.col("id").alias("a"), "column_index", F.col("pattern").alias("p")).join(b.select(F.col("id").alias("b"), "column_index", F.col("pattern").alias("q")), "column_index")
    return x.groupBy("a", "b").agg(F.avg(F.col("p").eqNullSafe(F.col("q")).cast("double")).alias("concordance"))


def stability(pairs: DataFrame, concordance: DataFrame) -> DataFrame:
    """a, b, score: geometric mean of row and column Jaccard times the concordance of patterns."""
    return pairs.join(concordance, ["a", "b"]).select("a", "b", (F.sqrt(F.col("row_jaccard") * F.col("column_jaccard")) * F.col("concordance")).alias("score"))


def controls(truths: DataFrame, universe: DataFrame, element: str, ratio: float = 0.2, seed: str = "control-1") -> DataFrame:
    """id, control, element: members of three perturbed copies of each truth (id, element).

    RANDOM_MATCHED draws as many elements of ``universe`` (id, element); REMOVED lacks a part ``ratio`` of the members, one at least
    but never all; ADDED has as many more. A truth that cannot be changed so has no such control.
    """
    size = truths.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * ratio)))
    ranked = lambda df, name: df.withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy(draw(f"{seed}:{name}", "id", element), element))).join(size, "id")
    matched = ranked(universe, "matched").filter("__rank <= n")
    removed = ranked(truths, "removed").filter("n > 1 AND __rank > least(n - 1, k)")
    outside = ranked(universe.join(truths, ["id", element], "left_anti"), "added").filter("__rank <= k")
    grown = truths.join(outside.select("id").distinct(), "id", "left_semi").select("id", element).unionByName(outside.select("id", element))
    parts = {"RANDOM_MATCHED": matched, "REMOVED": removed, "ADDED": grown}
    out = [df.select("id", F.lit(name).alias("control"), element) for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def alignment(records: DataFrame) -> DataFrame:
    """truth, objective, control, n, median, favorable, improvement of (truth, objective, direction, control, value, valid).

    The row whose control is GROUND_TRUTH is compared with the valid rows of each other control.
    """
    own = records.filter("control = 'GROUND_TRUTH'").select("truth", "objective", F.col("value").alias("own"))
    x = records.filter("control <> 'GROUND_TRUTH' AND valid AND value IS NOT NULL").join(own, ["truth", "objective"])
    better = F.when(F.col("direction") == "MINIMIZE", F.col("value") - F.col("own")).otherwise(F.col("own") - F.col("value"))
    return x.groupBy("truth", "objective", "control").agg(
        F.count(F.lit(1)).alias("n"), F.median("value").alias("median"), F.avg((better >= 0).cast("double")).alias("favorable"), F.avg(better).alias("improvement")
    )


def evaluable(members: DataFrame, annotations: DataFrame, biclusters: DataFrame, min_members: int = 10, min_nonmembers: int = 20, min_events: int = 10) -> DataFrame:
    """id, annotation, members, nonmembers, reason: whether an annotation can be tested for a bicluster, null if so.

    annotations: annotation, row_index, value (null: unknown), event (null where the annotation has none). Every bicluster meets
    every annotation, so the totals of an annotation less its members are its nonmembers: one join on rows, no pairs of rows.
    """
    known = annotations.filter("value IS NOT NULL")
    both = F.count_if(F.col("event").isNotNull())
    total = known.groupBy("annotation").agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("events"), both.alias("timed"))
    inside = members.join(known, "row_index").groupBy("id", "annotation").agg(F.count(F.lit(1)).alias("members"))
    names = annotations.select("annotation").distinct().join(total, "annotation", "left")
    x = biclusters.select("id").distinct().withColumn("k", F.lit(0)).join(names.withColumn("k", F.lit(0)), "k").join(inside, ["id", "annotation"], "left")
    x = x.withColumn("members", F.coalesce("members", F.lit(0).cast("long"))).withColumn("nonmembers", F.coalesce("n", F.lit(0).cast("long")) - F.col("members"))
    reason = (
        F.when(F.col("members") < min_members, "insufficient_members").when(F.col("nonmembers") < min_nonmembers, "insufficient_nonmembers")
        .when((F.col("timed") > 0) & (F.col("events") < min_events), "insufficient_events")
    )
    return x.select("id", "annotation", "members", "nonmembers", reason.alias("reason"))


def largest_good(nodes: DataFrame, parents: DataFrame, utilities: list[str], max_degradation: float = 0.15, max_rate: float = 0.20) -> DataFrame:
    """id, degradation, source: the largest biclusters of every nest before quality degrades, a row for each bicluster that one stands for.

    nodes: id, area and the utility columns (0 to 1); parents: inner, parent. From the innermost outwards a container replaces what
    was chosen inside it if no utility loses more than ``max_degradation``, nor more than ``max_rate`` for each unit of log area.
    One round of Spark jobs for each level of nesting; what is chosen so far is a written table.
    """
    tree = nodes.join(parents.select(F.col("inner").alias("id"), "parent"), "id", "left")
    tree = cut(tree, "nest-tree")
    level = cut(tree.filter("parent IS NULL").select("id", F.lit(0).alias("depth")), "nest-depth")
    depths, last = level, level
    while True:
        last = cut(tree.join(last.select(F.col("id").alias("parent"), "depth"), "parent").select("id", (F.col("depth") + 1).alias("depth")), "nest-depth")
        if last.isEmpty():
            break
        depths = depths.unionByName(last)
    depths = cut(depths, "nest-depths")
    deepest = depths.agg(F.max("depth")).first()[0]
    own = [F.col(u).alias(f"own_{u}") for u in utilities]
    chosen = sources = None  # owner, id, degradation and what the comparison needs; id, source
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = tree.join(depths.filter(F.col("depth") == depth), "id", "left_semi")
        alone = here.select(F.col("id").alias("owner"), "id", "area", *utilities, F.lit(0.0).alias("degradation"))
        if chosen is None:
            chosen = cut(alone, "nest-chosen")
            sources = chosen.select("id", F.col("id").alias("source"))
            continue
        under = chosen.join(tree.select(F.col("id").alias("owner"), "parent"), "owner").drop("owner").withColumnRenamed("parent", "owner")
        x = under.join(here.select(F.col("id").alias("owner"), F.col("area").alias("own_area"), *own), "owner")
        loss: Column = F.greatest(F.lit(0.0), *[F.col(u) - F.col(f"own_{u}") for u in utilities])
        x = x.withColumn("loss", loss).withColumn("rate", F.col("loss") / F.greatest(F.ln(F.col("own_area") / F.col("area")), F.lit(1e-12)))
        verdict = x.groupBy("owner").agg(
            F.bool_and((F.col("loss") <= max_degradation + 1e-12) & (F.col("rate") <= max_rate + 1e-12)).alias("good"),
            F.max(F.greatest("loss", "degradation")).alias("worst"),
        )
        verdict = cut(verdict, "nest-verdict")
        up = alone.join(verdict, "owner", "left").filter("good IS NULL OR good")
        up = cut(up.withColumn("degradation", F.coalesce("worst", "degradation")).select(*alone.columns), "nest-up")
        moved = under.join(verdict.filter("good"), "owner").select("id", F.col("owner").alias("to"))
        sources = sources.join(moved, "id", "left").select(F.coalesce("to", "id").alias("id"), "source")
        sources = cut(sources.unionByName(up.select("id", F.col("id").alias("source"))), "nest-sources")
        down = under.join(verdict.filter("NOT good"), "owner", "left_semi")
        chosen = cut(up.unionByName(down.select(*alone.columns)), "nest-chosen")
    if chosen is None:
        return nodes.select("id", F.lit(0.0).alias("degradation"), F.col("id").alias("source"))
    return chosen.select("id", "degradation").join(sources, "id")
