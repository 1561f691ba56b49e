"""Overlap of biclusters given as memberships: (id, row_index) and (id, column_index). All pair counts come from equi-joins on elements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame, element: str) -> DataFrame:
    """a, b, both, a_size, b_size of the pairs that share an element."""
    na, nb = (x.groupBy("id").agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    pairs = a.select(F.col("id").alias("a"), element).join(b.select(F.col("id").alias("b"), element), element)
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    pairs = pairs.join(na.select(F.col("id").alias("a"), F.col("n").alias("a_size")), "a")
    return pairs.join(nb.select(F.col("id").alias("b"), F.col("n").alias("b_size")), "b")


def jaccard_pairs(a_rows: DataFrame, a_columns: DataFrame, b_rows: DataFrame, b_columns: DataFrame) -> DataFrame:
    """a, b, row_jaccard, column_jaccard, similarity (geometric mean), distance of pairs that share a row and a column."""
    j = F.col("both") / (F.col("a_size") + F.col("b_size") - F.col("both"))
    r = overlap(a_rows, b_rows, "row_index").select("a", "b", j.alias("row_jaccard"), F.col("both").alias("shared_rows"))
    c = overlap(a_columns, b_columns, "column_index").select("a", "b", j.alias("column_jaccard"), F.col("both").alias("shared_columns"))
    out = r.join(c, ["a", "b"]).withColumn("similarity", F.sqrt(F.col("row_jaccard") * F.col("column_jaccard")))
    return out.withColumn("distance", 1 - F.col("similarity"))


def containment(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """inner, outer: strict containment on both axes."""
    r, c = overlap(rows, rows, "row_index"), overlap(columns, columns, "column_index")
    inside = lambda x, n: x.filter((F.col("both") == F.col("a_size")) & (F.col("a") != F.col("b"))).select("a", "b", (F.col("a_size") < F.col("b_size")).alias(n))
    out = inside(r, "less_rows").join(inside(c, "less_columns"), ["a", "b"]).filter("less_rows OR less_columns")
    return out.select(F.col("a").alias("inner"), F.col("b").alias("outer"))


def parents(contained: DataFrame, sizes: DataFrame) -> DataFrame:
    """The smallest strict container of each bicluster; sizes (id, cells)."""
    s = contained.join(sizes.withColumnRenamed("id", "outer"), "outer")
    return s.groupBy("inner").agg(F.min(F.struct("cells", "outer")).alias("p")).select("inner", F.col("p.outer").alias("parent"))


def best_match(pairs: DataFrame) -> DataFrame:
    """For each a its best b: similarity, then row and column Jaccard, then the highest identifier."""
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), F.desc("row_jaccard"), F.desc("column_jaccard"), F.desc("b"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def relevance(a_ids: DataFrame, pairs_rows: DataFrame, pairs_columns: DataFrame) -> DataFrame:
    """One row: root of (mean best row Jaccard * mean best column Jaccard); the bests are independent, unmatched count 0."""
    best = lambda p, n: p.withColumn("j", F.col("both") / (F.col("a_size") + F.col("b_size") - F.col("both"))).groupBy("a").agg(F.max("j").alias(n))
    out = a_ids.select(F.col("id").alias("a")).join(best(pairs_rows, "r"), "a", "left").join(best(pairs_columns, "c"), "a", "left")
    return out.agg(F.sqrt(F.avg(F.coalesce("r", F.lit(0.0))) * F.avg(F.coalesce("c", F.lit(0.0)))).alias("value"))


def coverage(best: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of truths whose best similarity reaches each threshold."""
    s = F.coalesce(F.col("similarity"), F.lit(0.0))
    out = truths.select(F.col("id").alias("a")).join(best, "a", "left")
    return out.agg(*[F.avg((s >= t).cast("double")).alias("coverage_at_" + str(t).replace(".", "_")) for t in thresholds])


def cell_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cells of the multiset union, max of both multiplicities; a and b (row_index, column_index)."""
    count = lambda x, n: x.groupBy("row_index", "column_index").agg(F.count(F.lit(1)).alias(n))
    both = count(a, "na").join(count(b, "nb"), ["row_index", "column_index"], "full_outer")
    return both.agg(F.sum(F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("cells"))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum-weight one-to-one matching by shortest augmenting paths."""
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def nearest_distance(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, nearest: distance to the closest other bicluster, 1 where nothing is shared."""
    near = pairs.filter("a <> b").groupBy("a").agg(F.min("distance").alias("nearest"))
    return ids.join(near, ids["id"] == near["a"], "left").select("id", F.coalesce("nearest", F.lit(1.0)).alias("nearest"))


def neighbour_mates(cells: DataFrame, pairs: DataFrame, radius: int = 1, min_jaccard: float = 0.1) -> DataFrame:
    """a, b of archive cells (id, x, y) at most ``radius`` apart whose Jaccards reach the minimum: a band join by exploded neighbours."""
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    near = cells.select(F.col("id").alias("a"), "x", "y", F.explode(steps).alias("s")).select("a", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    out = near.join(cells.withColumnRenamed("id", "b"), ["x", "y"]).filter("a <> b")
    ok = pairs.filter((F.col("row_jaccard") >= min_jaccard) & (F.col("column_jaccard") >= min_jaccard)).select("a", "b")
    return out.join(ok, ["a", "b"], "left_semi").select("a", "b")
