"""One-to-one matching of bicluster sets by the components of their overlap graph, and what follows from it.

Only pairs that overlap can add to a matching, so a best matching of the whole is one of each connected component. Components are
labelled by joins; each is then one small assignment problem. Stability of sets, support of single biclusters and intervals of the
accuracy measures are aggregations of matched pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .structure import assignment


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the graph of ``edges`` (a, b): labels pass to neighbours and to their own label until none changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("c").alias("heard")), "b").groupBy("a").agg(F.min("heard").alias("heard"))
        new = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "c", F.least("c", "heard").alias("m"))
        hooked = new.groupBy("c").agg(F.min("m").alias("h")).withColumnRenamed("c", "node")  # a label's owner hears what its members heard
        new = cut(new.join(hooked, "node", "left").select("node", "c", F.least("m", F.coalesce("h", "m")).alias("m")), "labels")
        owner = new.select(F.col("node").alias("m"), F.col("m").alias("up"))
        after = cut(new.join(owner, "m", "left").select("node", F.coalesce("up", "m").alias("c"), (F.coalesce("up", "m") != F.col("c")).alias("moved")), "labels")
        if after.filter("moved").isEmpty():
            return after.select("node", F.col("c").alias("component"))
        label = after.select("node", "c")


def matching(pairs: DataFrame, *groups: str) -> DataFrame:
    """groups, a, b, weight: the pairs of a maximum-weight one-to-one matching of ``pairs`` (groups, a, b, weight) in each group; pairs without weight add nothing and are left out."""
    pairs = cut(pairs.filter("weight > 0").select(*groups, "a", "b", "weight"), "weights")
    side = lambda s, c: F.struct(*groups, F.lit(s).alias("side"), F.col(c).cast("long").alias("id"))
    found = components(pairs.select(side(0, "a").alias("a"), side(1, "b").alias("b")))
    of = found.select(F.col("node").alias("node"), F.xxhash64("component").alias("h"), "component")
    held = pairs.withColumn("node", side(0, "a")).join(of, "node").drop("node")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, i = np.unique(t["a"].to_numpy(), return_inverse=True)
        b, j = np.unique(t["b"].to_numpy(), return_inverse=True)
        w, at = np.zeros((len(a), len(b))), np.full((len(a), len(b)), -1)
        w[i, j], at[i, j] = t["weight"].to_numpy(), np.arange(len(t))
        keep = [int(at[x, y]) for x, y in assignment(w) if at[x, y] >= 0]
        return t.select([*groups, "a", "b", "weight"]).take(pa.array(keep, pa.int64()))

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*groups, "a", "b", "weight"))
    return held.drop("h").groupBy("component").applyInArrow(run, schema)


def matched_weight(pairs: DataFrame, *groups: str) -> DataFrame:
    """groups, matched: total weight of the best one-to-one matching; without groups one row."""
    out = matching(pairs, *groups)
    total = F.coalesce(F.sum("weight").cast("double"), F.lit(0.0)).alias("matched")
    return out.groupBy(*groups).agg(total) if groups else out.agg(total)


def repertoire_stability(scores: DataFrame, sizes: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """One row for each pair of sets: matched_count, mean and median matched score, coverage at each threshold.

    ``scores``: left, right, a, b, weight; ``sizes``: left, right, left_count, right_count. As many pairs are matched as the smaller
    set has members; those that share nothing score 0.
    """
    found = cut(matching(scores, "left", "right"), "matched")
    n = sizes.withColumn("matched_count", F.least("left_count", "right_count")).join(found.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")), ["left", "right"], "left")
    none = F.col("matched_count") - F.coalesce("n", F.lit(0))
    zeros = n.filter(none > 0).select("left", "right", F.explode(F.array_repeat(F.lit(0.0), none.cast("int"))).alias("weight"))
    every = found.select("left", "right", F.col("weight").cast("double").alias("weight")).unionByName(zeros)
    per = every.groupBy("left", "right").agg(
        F.avg("weight").alias("mean"), F.median("weight").alias("median"), *[F.count_if(F.col("weight") >= t).alias(f"at_{k}") for k, t in enumerate(thresholds)]
    )
    whole = F.greatest("left_count", "right_count", F.lit(1))
    cover = [(F.coalesce(f"at_{k}", F.lit(0)) / whole).alias(f"coverage_at_{t:g}".replace(".", "_")) for k, t in enumerate(thresholds)]
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(f"{c}_matched_stability")
    return n.join(per, ["left", "right"], "left").select("left", "right", "left_count", "right_count", "matched_count", zero("mean"), zero("median"), *cover)


def reference_stability(scores: DataFrame, references: DataFrame, comparisons: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each bicluster of a reference set (id): how it is matched in every comparison (right); unmatched scores 0.

    ``scores``: right, a (of the reference), b, weight; the result has comparison_count, matched_count, support_fraction and the mean,
    median, minimum and maximum of the matched scores.
    """
    found = matching(scores, "right").select("right", F.col("a").alias("id"), F.col("weight").cast("double").alias("weight"))
    every = references.select("id").crossJoin(comparisons.select("right"))  # one row of the result's input each: a set by its few comparisons
    x = F.coalesce("weight", F.lit(0.0))
    return every.join(found, ["right", "id"], "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("comparison_count"), F.count_if(x >= threshold).alias("matched_count"), F.avg((x >= threshold).cast("double")).alias("support_fraction"),
        F.avg(x).alias("mean_matched_stability"), F.median(x).alias("median_matched_stability"), F.min(x).alias("minimum_matched_stability"), F.max(x).alias("maximum_matched_stability"),
    )


# intervals


def drawn(ids: DataFrame, draws: int, seed: int, offset: int = 0) -> DataFrame:
    """draw, id, times: how often each of ``ids`` (id) comes up in each bootstrap draw of as many; not at all: no row.

    Draw d takes its numbers from a generator of (seed, offset, d), so tasks make them without one another.
    """
    spark = ids.sparkSession
    numbered = cut(ids.select("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("at")), "numbered")
    n = numbered.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column(0).to_pylist():
                times = np.bincount(np.random.default_rng([seed, offset, d]).integers(0, n, n), minlength=n)
                at = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d)), pa.array(at), pa.array(times[at])], ["draw", "at", "times"])

    if n == 0:
        return numbered.select(F.lit(0).cast("long").alias("draw"), "id", F.lit(0).cast("long").alias("times"))
    return spark.range(draws).mapInArrow(run, "draw long, at long, times long").join(numbered, "at").select("draw", "id", "times")


def interval(values: DataFrame, value: str, level: float = 0.95) -> tuple[Column, Column]:
    """Columns low and high: the percentile interval of ``value``."""
    at = lambda q: F.percentile(value, F.lit(q))
    return at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high")


def bootstrap_relevance(best: DataFrame, draws: int = 2000, level: float = 0.95, seed: int = 0, offset: int = 0) -> DataFrame:
    """One row: estimate, low, high of the root of (mean best row Jaccard * mean best column Jaccard); best: id, r, c."""
    weights = drawn(best.select("id"), draws, seed, offset)
    score = lambda w: F.sqrt(F.sum(F.col("r") * w) * F.sum(F.col("c") * w)) / F.sum(w)
    per = weights.join(best, "id").groupBy("draw").agg(score(F.col("times")).alias("v"))
    return best.agg(score(F.lit(1)).alias("estimate")).crossJoin(per.agg(*interval(per, "v", level)))  # one row each


def cell_patterns(a_cells: DataFrame, b_cells: DataFrame) -> DataFrame:
    """pattern, side (0: a, 1: b), id, cells: cells (id, row_index, column_index) that the same biclusters cover are one pattern with a count."""
    both = a_cells.select("row_index", "column_index", F.struct(F.lit(0).alias("side"), F.col("id").cast("long").alias("id")).alias("m"))
    both = both.unionByName(b_cells.select("row_index", "column_index", F.struct(F.lit(1).alias("side"), F.col("id").cast("long").alias("id")).alias("m")))
    covered = both.groupBy("row_index", "column_index").agg(F.sort_array(F.collect_list("m")).alias("members"))
    counted = cut(covered.groupBy("members").agg(F.count(F.lit(1)).alias("cells")).withColumn("pattern", F.monotonically_increasing_id()), "cell-patterns")
    return counted.select("pattern", "cells", F.explode("members").alias("m")).select("pattern", F.col("m.side").alias("side"), F.col("m.id").alias("id"), "cells")


def bootstrap_error(shared: DataFrame, a_cells: DataFrame, b_cells: DataFrame, draws: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: estimate, low, high of the clustering-error complement. Both sets (a: detected, b: true) are drawn anew, copies count, and every draw is matched again.

    ``shared``: a, b, weight (shared cells). The union of a draw is a sum over patterns of cells, not over cells.
    """
    a_ids, b_ids = (x.select("id").distinct() for x in (a_cells, b_cells))
    once = lambda ids: ids.select(F.lit(-1).cast("long").alias("draw"), "id", F.lit(1).cast("long").alias("times"))  # noqa: E731  the sets themselves
    drawn_a = cut(drawn(a_ids, draws, seed, 2).unionByName(once(a_ids)), "drawn")
    drawn_b = cut(drawn(b_ids, draws, seed, 3).unionByName(once(b_ids)), "drawn")
    times = drawn_a.withColumn("side", F.lit(0)).unionByName(drawn_b.withColumn("side", F.lit(1)))
    per = cell_patterns(a_cells, b_cells).join(times, ["side", "id"]).groupBy("draw", "pattern", "cells")
    per = per.agg(F.sum(F.when(F.col("side") == 0, F.col("times")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("times")).otherwise(0)).alias("y"))
    union = per.groupBy("draw").agg(F.sum(F.col("cells") * F.greatest("x", "y")).alias("union"))
    pairs = shared.filter("weight > 0").join(drawn_a.select("draw", F.col("id").alias("a"), F.col("times").alias("x")), "a")
    pairs = pairs.join(drawn_b.select("draw", F.col("id").alias("b"), F.col("times").alias("y")), ["draw", "b"])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, i = np.unique(t["a"].to_numpy(), return_inverse=True)
        b, j = np.unique(t["b"].to_numpy(), return_inverse=True)
        w, x, y = np.zeros((len(a), len(b))), np.zeros(len(a), int), np.zeros(len(b), int)
        w[i, j], x[i], y[j] = t["weight"].to_numpy(), t["x"].to_numpy(), t["y"].to_numpy()
        w = np.repeat(np.repeat(w, x, 0), y, 1)  # a bicluster drawn twice may be matched twice
        return pa.table({"draw": [key[0].as_py()], "matched": [float(sum(w[p, q] for p, q in assignment(w)))]})

    matched = pairs.select("draw", "a", "b", "weight", "x", "y").groupBy("draw").applyInArrow(run, "draw long, matched double")
    value = F.coalesce(F.coalesce("matched", F.lit(0.0)) / F.nullif("union", F.lit(0)), F.lit(0.0))
    every = cut(union.join(matched, "draw", "left").select("draw", value.alias("v")), "draws")
    return every.filter("draw = -1").select(F.col("v").alias("estimate")).crossJoin(every.filter("draw >= 0").agg(*interval(every, "v", level)))  # one row each
