"""Groups of columns whose profiles over a candidate's rows run alike: anchors far from one another and their nearest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .fit import residual_scale
from .prepare import ZERO, required_support


def additive_profiles(inside: DataFrame, stats: DataFrame) -> DataFrame:
    """candidate, row_index, column_index, p, scale: values less their column's median among the candidate's rows."""
    middle = inside.groupBy("candidate", "column_index").agg(F.median("num").alias("__m"))
    scale = stats.select("column_index", residual_scale(F.col("robust_range"), F.col("median")).alias("scale"))
    return inside.join(middle, ["candidate", "column_index"]).join(scale, "column_index").select("candidate", "row_index", "column_index", (F.col("num") - F.col("__m")).alias("p"), "scale")


def multiplicative_profiles(inside: DataFrame, stats: DataFrame) -> DataFrame:
    """The same columns: values over their column's scale, compared at scale 1."""
    scale = stats.select("column_index", residual_scale(F.col("robust_range"), F.col("median")).alias("s"))
    return inside.join(scale, "column_index").select("candidate", "row_index", "column_index", (F.col("num") / F.col("s")).alias("p"), F.lit(1.0).alias("scale"))


def _distances(profiles: DataFrame, anchors: DataFrame, required: DataFrame, either_sign: bool) -> DataFrame:
    """candidate, anchor, column_index, distance to each candidate's anchor; null where too few rows have both."""
    at = profiles.join(anchors, "candidate").filter("column_index = anchor").select("candidate", "row_index", "anchor", F.col("p").alias("q"), F.col("scale").alias("t"))
    x = profiles.join(at, ["candidate", "row_index"])
    off = lambda d: F.when(d.isNotNull(), F.least(F.lit(1.0), F.abs(d) / F.greatest("scale", "t")))
    near = F.avg(off(F.col("p") - F.col("q")))
    if either_sign:
        near = F.least(near, F.avg(off(F.col("p") + F.col("q"))))
    out = x.groupBy("candidate", "anchor", "column_index").agg(F.count(F.col("p") + F.col("q")).alias("n"), near.alias("d")).join(required, "candidate")
    return out.select("candidate", "anchor", "column_index", F.when(F.col("column_index") == F.col("anchor"), 0.0).when(F.col("n") >= F.col("required"), F.round("d", 12)).alias("distance"))


def anchor_distances(profiles: DataFrame, anchors: int = 8, either_sign: bool = False) -> DataFrame:
    """candidate, anchor, column_index, distance for up to ``anchors`` columns of each candidate: first the best supported one, then
    always the column farthest from those before it (the smallest of equals), while any is apart.

    Each round is one join on (candidate, row) and is written to the shared folder, so no column is compared with all others.
    """
    profiles = cut(profiles, "profiles")
    required = profiles.groupBy("candidate").agg(required_support(F.count_distinct("row_index")).alias("required"))
    support = profiles.groupBy("candidate", "column_index").agg(F.count("p").alias("n"))
    best = support.groupBy("candidate").agg(F.max(F.struct("n", (-F.col("column_index")).alias("c"))).alias("s"))
    out = cut(_distances(profiles, best.select("candidate", (-F.col("s.c")).alias("anchor")), required, either_sign), "anchors")
    for _ in range(anchors - 1):
        near = out.groupBy("candidate", "column_index").agg(F.min("distance").alias("near"), F.max((F.col("anchor") == F.col("column_index")).cast("int")).alias("used"))
        far = near.filter((F.col("used") == 0) & (F.col("near") > ZERO))  # a column without any distance has none here
        next_ = far.groupBy("candidate").agg(F.max(F.struct("near", (-F.col("column_index")).alias("c"))).alias("s")).select("candidate", (-F.col("s.c")).alias("anchor"))
        more = cut(_distances(profiles, next_, required, either_sign), "anchors")
        if more.isEmpty():
            break
        out = out.unionByName(more)
    return out


def largest_gap(distances: DataFrame, minimum: int = 2) -> DataFrame:
    """candidate, anchor, column_index, place, cut: columns in order of distance, and the place of the widest gap after ``minimum`` columns
    (the first of equals; all columns where none is apart); anchors with fewer columns are left out."""
    part = Window.partitionBy("candidate", "anchor")
    order = part.orderBy("distance", "column_index")
    x = distances.filter("distance IS NOT NULL").withColumn("place", F.row_number().over(order)).withColumn("gap", F.col("distance") - F.lag("distance").over(order))
    gap = F.when((F.col("place") > minimum) & (F.col("gap") > ZERO), F.struct("gap", (1 - F.col("place")).alias("at")))
    n = F.count(F.lit(1)).over(part)
    x = x.withColumn("n", n).withColumn("widest", F.max(gap).over(part)).filter(F.col("n") >= minimum)
    return x.select("candidate", "anchor", "column_index", "place", F.coalesce(-F.col("widest.at"), F.col("n")).cast("int").alias("cut"))


def proposals(distances: DataFrame, minimum: int = 2) -> DataFrame:
    """candidate, columns: the distinct groups that the anchors propose, each up to its widest gap and the ``minimum`` nearest alone.

    A group is one array, at most as long as the candidate has columns.
    """
    x = largest_gap(distances, minimum).withColumn("upto", F.explode(F.array_distinct(F.array("cut", F.lit(minimum))))).filter("place <= upto")
    groups = x.groupBy("candidate", "anchor", "upto").agg(F.array_sort(F.collect_list("column_index")).alias("columns"))
    return groups.select("candidate", "columns").distinct()
