"""Membership moves: one row or column of a parent added, removed or swapped, at random or by its loss.

Elements of a universe are numbered 0 .. n - 1. What a parent lacks is drawn by position among the elements outside it, so no
parent is ever joined with a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fit import residual_scale
from .prepare import ZERO, required_support
from .seeds import draw

OPERATIONS = ("add", "remove", "swap")


def _sizes(members: DataFrame, universe: DataFrame) -> DataFrame:
    whole = universe.agg(F.count(F.lit(1)).alias("population"))
    return members.groupBy("candidate").agg(F.count(F.lit(1)).alias("held")).crossJoin(F.broadcast(whole))  # one row


def movable(members: DataFrame, universe: DataFrame, operation: str, minimum: int = 2) -> DataFrame:
    """candidate: parents that the operation applies to; none grows beyond the universe or shrinks below ``minimum``."""
    rule = "held > least" if operation == "remove" else "held < population"
    return _sizes(members, universe).withColumn("least", F.lit(minimum)).filter(rule).select("candidate")


def outside(members: DataFrame, universe: DataFrame, element: str, pool: int = 64, seed: str = "outside-1") -> DataFrame:
    """candidate, element: ``pool`` elements that a candidate lacks (all, if there are no more), one from each of equal stretches."""
    own = Window.partitionBy("candidate")
    whole = universe.agg(F.count(F.lit(1)).alias("population"))
    x = members.select("candidate", F.col(element).cast("long").alias("e"), (F.row_number().over(own.orderBy(element)) - 1).cast("long").alias("rank"), F.count(F.lit(1)).over(own).alias("held"))
    x = x.crossJoin(F.broadcast(whole)).withColumn("free", F.col("population") - F.col("held"))  # one row
    x = x.withColumn("take", F.least(F.lit(pool).cast("long"), "free"))
    none = F.lit(-1).cast("long")  # the member itself; the first member also brings the places to fill
    x = x.withColumn("k", F.explode(F.when((F.col("rank") == 0) & (F.col("take") > 0), F.sequence(none, F.col("take") - 1)).otherwise(F.array(none))))
    place = F.floor((F.col("k") + draw(seed, "candidate", "k")) * F.col("free") / F.col("take"))
    x = x.select("candidate", (F.col("k") >= 0).cast("int").alias("wanted"), F.when(F.col("k") < 0, F.col("e") - F.col("rank")).otherwise(place).alias("at"))  # elements outside before each member
    so_far = own.orderBy("at", "wanted").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("before", F.sum(1 - F.col("wanted")).over(so_far))
    return x.filter("wanted = 1").select("candidate", (F.col("at") + F.col("before")).alias(element))


def _moved(members: DataFrame, parents: DataFrame, removed: DataFrame | None, added: DataFrame | None, element: str) -> DataFrame:
    """Each parent has at most one element to lose and one to win, so one join with its members makes the offspring; its first member brings the new one."""
    first = members.groupBy("candidate").agg(F.min(element).alias("__first")).join(parents, "candidate", "left_semi")
    change = first
    for name, df in (("__out", removed), ("__in", added)):
        change = change.withColumn(name, F.lit(None).cast("long")) if df is None else change.join(df.select("candidate", F.col(element).cast("long").alias(name)), "candidate", "left")
    stays = F.when(F.col("__out").isNull() | (F.col(element) != F.col("__out")), F.col(element).cast("long"))
    comes = F.when(F.col(element) == F.col("__first"), F.col("__in"))
    return members.join(change, "candidate").select("candidate", F.explode(F.array_compact(F.array(stays, comes))).alias(element))


def random_move(members: DataFrame, universe: DataFrame, element: str, operation: str, minimum: int = 2, seed: str = "move-1") -> DataFrame:
    """candidate, element of the offspring of every parent that the operation (add, remove, swap) applies to."""
    removed = added = None
    if operation != "add":
        first = F.min(F.struct(draw(seed, "candidate", element).alias("u"), F.col(element).alias("e")))
        removed = members.groupBy("candidate").agg(first.alias("s")).select("candidate", F.col("s.e").alias(element))
    if operation != "remove":
        added = outside(members, universe, element, 1, seed)
    return _moved(members, movable(members, universe, operation, minimum), removed, added, element)


def guided_move(members: DataFrame, universe: DataFrame, element: str, operation: str, loss: Callable[[DataFrame], DataFrame], minimum: int = 2, pool: int = 64, seed: str = "guided-1") -> DataFrame:
    """The same, but of a pool of members the one with the greatest loss leaves (the largest of equals), and of a pool of elements outside
    the one with the least enters (the smallest of equals).

    ``loss`` maps (candidate, element) to (candidate, element, loss); a member without a loss counts 0, an element outside infinite.
    """
    removed = added = None
    if operation != "add":
        rank = F.row_number().over(Window.partitionBy("candidate").orderBy(draw(seed, "candidate", element), element))
        inside = members.select("candidate", element, rank.alias("r")).filter(F.col("r") <= pool).drop("r")
        scored = inside.join(loss(inside), ["candidate", element], "left").select("candidate", F.struct(F.coalesce("loss", F.lit(0.0)).alias("l"), F.col(element).alias("e")).alias("s"))
        removed = scored.groupBy("candidate").agg(F.max("s").alias("s")).select("candidate", F.col("s.e").alias(element))
    if operation != "remove":
        free = outside(members, universe, element, pool, seed)
        scored = free.join(loss(free), ["candidate", element], "left").select("candidate", F.struct(F.coalesce("loss", F.lit(float("inf"))).alias("l"), F.col(element).alias("e")).alias("s"))
        added = scored.groupBy("candidate").agg(F.min("s").alias("s")).select("candidate", F.col("s.e").alias(element))
    return _moved(members, movable(members, universe, operation, minimum), removed, added, element)


def column_compatibility(cells: DataFrame, rows: DataFrame, columns: DataFrame, stats: DataFrame, effects: DataFrame, ratio: float = 0.8) -> DataFrame:
    """candidate, column_index, loss of numeric columns against a candidate's rows: the least error of a constant column and of one that
    follows the candidate's row effects (candidate, row_index, pattern: additive or multiplicative, alpha).

    A column with too few observed rows, or with effects for fewer than two of them, has no loss.
    """
    scale = stats.select("column_index", "robust_range", residual_scale(F.col("robust_range"), F.col("median")).alias("scale"))
    x = cells.join(columns.select("candidate", "column_index"), "column_index").join(rows.select("candidate", "row_index"), ["candidate", "row_index"]).join(scale, "column_index")
    key = ["candidate", "column_index"]
    support = x.groupBy(*key).agg(F.count(F.lit(1)).alias("of"), F.count("num").alias("seen"), F.median("num").alias("middle"))
    x = x.filter("num IS NOT NULL").join(support.filter(F.col("seen") >= required_support(F.col("of"), ratio=ratio)), key)
    d = F.abs(F.col("num") - F.col("middle"))
    flat = F.when(F.col("robust_range") > ZERO, F.least(F.lit(1.0), d / F.col("robust_range"))).otherwise((d > ZERO).cast("double"))
    constant = x.groupBy(*key).agg(F.avg(flat).alias("loss"))
    shift = F.col("pattern") == "additive"
    y = x.join(effects, ["candidate", "row_index"]).filter(shift | (F.abs("alpha") > ZERO))
    y = y.withColumn("estimate", F.when(shift, F.col("num") - F.col("alpha")).otherwise(F.col("num") / F.col("scale") / F.col("alpha")))
    beta = y.groupBy(*key, "pattern").agg(F.median("estimate").alias("beta"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    off = F.when(shift, F.abs(F.col("num") - F.col("alpha") - F.col("beta")) / F.col("scale")).otherwise(F.abs(F.col("num") / F.col("scale") - F.col("alpha") * F.col("beta")))
    joint = y.join(beta, [*key, "pattern"]).groupBy(*key, "pattern").agg(F.least(F.lit(1.0), F.avg(off)).alias("loss"))
    return constant.unionByName(joint.drop("pattern")).groupBy(*key).agg(F.min("loss").alias("loss"))
