"""Candidates as memberships, (candidate, row_index) and (candidate, column_index), made by Spark from the cells themselves.

Random choices hash (seed, candidate, element), so a lost task makes the same candidates again and no list passes the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from ..session import cut
from .prepare import ZERO

#: How far above ``size`` the draws kept at first are expected to be, as a multiple of its root and as a number.
_SPREAD, _MORE = 4, 8
#: Candidates, and elements, that one task call hashes against each other, about.
_BLOCK = 2048


def draw(seed: str, *parts: str) -> Column:
    """A number in [0, 1) that depends on the seed and the values of ``parts`` alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _smallest(df: DataFrame, element: str, order: list[Column], size: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy(*order, F.col(element)))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= size).drop("__rank")


def first_draws(asked: DataFrame, elements: DataFrame, candidate: str, element: str, seed: str) -> DataFrame:
    """The ``size`` smallest draws of each candidate: candidate, size, the columns of elements (stratum, element), ``__u`` (a draw's 52 bits) and ``__rank``.

    asked: candidate, stratum, size. A candidate draws from its own stratum, and to know its smallest draws every such pair is hashed, in
    pairs of blocks of ``_BLOCK`` rows at most. Few pairs leave a task: those below a limit that a candidate is expected to meet ``size +
    4 * sqrt(size) + 8`` times. That is no cut: candidates that find fewer than they need also take all that lies above their limit.
    """
    pool = elements.select("stratum", element).distinct()
    n, m = (x.groupBy("stratum").agg(F.count(F.lit(1)).alias(c)) for x, c in ((pool, "__n"), (asked, "__m")))
    few = F.col("size") + _SPREAD * F.sqrt("size") + _MORE
    limit = F.floor(F.least(F.lit(1.0), few / F.col("__n")) * float(1 << digests.BITS)).cast("long")
    x = asked.filter("size > 0").join(n, "stratum").join(m, "stratum").withColumns({"__low": F.lit(0).cast("long"), "__high": limit})
    sizes = n.join(m, "stratum")
    pool = pool.join(sizes, "stratum")

    blocks = lambda c: F.ceil(F.col(c) / _BLOCK)
    dealt = lambda c, k: F.pmod(F.xxhash64(c), blocks(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), blocks(k) - 1))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["stratum", "__a", "__b"]
    right = pool.select("stratum", dealt(element, "__n").alias("__b"), every("__m").alias("__a"), element, F.coalesce(F.col(element).cast("string"), F.lit("")).alias("__end"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        text = lambda t, c: [v.encode() for v in t[c].to_pylist()]
        low, high = (left[c].to_numpy() for c in ("__low", "__high"))
        i, j, u = digests.heads_between(text(left, "__start"), text(right, "__end"), low, high) if left.num_rows and right.num_rows else (np.empty(0, np.int64),) * 3
        return pa.table({candidate: left[candidate].take(i), "stratum": left["stratum"].take(i), "size": left["size"].take(i), element: right[element].take(j), "__u": pa.array(u, pa.int64())})

    kinds = dict(elements.dtypes) | dict(asked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (candidate, "stratum", "size", element)) + ", __u long"

    def hashed(some: DataFrame) -> DataFrame:
        start = F.concat_ws(":", F.lit(seed), F.col(candidate).cast("string"), F.lit(""))
        left = some.select("stratum", dealt(candidate, "__m").alias("__a"), every("__n").alias("__b"), candidate, "size", "__low", "__high", start.alias("__start"))
        return left.repartition(parts, *place).groupBy(*place).cogroup(right.repartition(parts, *place).groupBy(*place)).applyInArrow(run, schema)

    found = cut(hashed(x), "draws")
    counts = found.groupBy(candidate, "stratum").agg(F.count(F.lit(1)).alias("__found"))
    short = x.join(counts, [candidate, "stratum"], "left").filter(F.coalesce("__found", F.lit(0)) < F.least("size", "__n"))
    more = hashed(short.withColumns({"__low": F.col("__high"), "__high": F.lit(1 << digests.BITS)}))
    out = found.unionByName(more).join(elements, ["stratum", element])
    rank = F.row_number().over(Window.partitionBy(candidate).orderBy("__u", element))
    return out.withColumn("__rank", rank).filter(F.col("__rank") <= F.col("size"))


def random_members(candidates: DataFrame, elements: DataFrame, element: str, seed: str = "draw-1") -> DataFrame:
    """candidate, element: exactly ``size`` elements of each candidate (candidate, size), drawn without replacement.

    A candidate draws from its own ``stratum`` alone: the draws are candidates times the elements of a stratum, so strata bound the work.
    """
    return first_draws(candidates, elements, "candidate", element, seed).select("candidate", element)


def nearest_rows(cells: DataFrame, anchors: DataFrame, columns: DataFrame, stats: DataFrame, size: int) -> DataFrame:
    """candidate, row_index, distance: the ``size`` rows nearest to each anchor (candidate, row_index).

    Distance: mean over the candidate's columns of the deviation from the anchor's value over the column's range, at most 1;
    a missing value of the row counts 1, columns that the anchor lacks count nothing.
    """
    mine = cells.join(anchors, "row_index").join(columns, ["candidate", "column_index"]).filter("num IS NOT NULL")
    mine = mine.join(stats.select("column_index", "robust_range"), "column_index").select("candidate", "column_index", F.col("num").alias("at"), "robust_range")
    d = F.abs(F.col("num") - F.col("at"))
    near = F.when(F.col("num").isNull(), 1.0).when(F.col("robust_range") > ZERO, F.least(F.lit(1.0), d / F.col("robust_range"))).otherwise((d > ZERO).cast("double"))
    out = cells.join(mine, "column_index").groupBy("candidate", "row_index").agg(F.round(F.avg(near), 9).alias("distance"))
    return _smallest(out, "row_index", [F.col("distance")], F.lit(size))


def best_columns(fits: DataFrame, size: int, maximum: float = 1.0) -> DataFrame:
    """candidate, column_index, error: the ``size`` columns that fit a candidate's rows best, none above ``maximum``."""
    return _smallest(fits.filter(F.col("error") <= maximum), "column_index", [F.round("error", 9)], F.lit(size)).select("candidate", "column_index", "error")


def _held(pairs: DataFrame, members: DataFrame, element: str) -> DataFrame:
    """candidate, element, in_a, in_b of what either parent (candidate, a, b) holds; a parent's members are never gathered into an array."""
    sides = pairs.select("candidate", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")), F.struct(F.col("b").alias("id"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))).alias("s"))
    return sides.select("candidate", "s.*").join(members, "id").groupBy("candidate", element).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def combine(pairs: DataFrame, members: DataFrame, element: str, how: str) -> DataFrame:
    """candidate, element of offspring (candidate, a, b): union, intersection, difference or symmetric difference of two parents' members."""
    keep = {"union": "in_a + in_b > 0", "intersection": "in_a + in_b = 2", "difference": "in_a = 1 AND in_b = 0", "symmetric": "in_a + in_b = 1"}[how]
    return _held(pairs, members, element).filter(keep).select("candidate", element)


def crossover(pairs: DataFrame, members: DataFrame, element: str, seed: str = "cross-1") -> DataFrame:
    """Uniform crossover: what both parents have stays, what one of them has stays by a fair draw."""
    both = combine(pairs, members, element, "intersection")
    one = combine(pairs, members, element, "symmetric").filter(draw(seed, "candidate", element) < 0.5)
    return both.unionByName(one)


def half_uniform(pairs: DataFrame, members: DataFrame, element: str, rate: float = 0.5, seed: str = "half-1") -> DataFrame:
    """The first parent's members; each element that one parent alone has changes sides with probability ``rate``."""
    keep = F.when(F.col("in_a") == F.col("in_b"), True).otherwise((F.col("in_a") == 1) != (draw(seed, "candidate", element) < rate))
    return _held(pairs, members, element).filter(keep).select("candidate", element)


def recombine(
    pairs: DataFrame, members: DataFrame, element: str, minimum: int = 2, maximum: int | None = None, rate: float = 0.5, losses: DataFrame | None = None, seed: str = "mix-1"
) -> DataFrame:
    """Recombination: a size between the parents' sizes, within ``minimum`` and ``maximum``, is drawn; what both parents have comes
    first, the rest from what one of them has. A candidate drawn above ``rate`` repeats its first parent.

    Without ``losses`` all draws are even, also among shared elements where they exceed the size. With ``losses`` (candidate,
    element, loss) shared elements all stay and the others come by weighted draws without replacement, 0.05 + (1 - loss) each,
    a missing or infinite loss counting 1.
    """
    held = _held(pairs, members, element)
    n = held.groupBy("candidate").agg(F.sum("in_a").alias("na"), F.sum("in_b").alias("nb"), F.count(F.lit(1)).alias("nu"))
    low = F.greatest(F.lit(minimum), F.least("na", "nb"))
    high = F.greatest(low, F.least(F.greatest("na", "nb"), "nu", F.lit(maximum) if maximum else F.col("nu")))
    n = n.withColumn("size", low + F.floor(draw(seed + ":size", "candidate") * (high - low + 1))).withColumn("mixed", draw(seed + ":apply", "candidate") < rate)
    x = held.join(n.select("candidate", "size", "mixed"), "candidate").withColumn("u", draw(seed, "candidate", element))
    both = F.col("in_a") + F.col("in_b") == 2
    if losses is not None:
        loss = F.when(F.abs("loss") < float("inf"), F.col("loss"))  # NaN is above infinity
        x = x.join(losses.select("candidate", element, "loss"), ["candidate", element], "left")
        x = x.withColumn("u", -F.log1p(-F.col("u")) / (0.05 + F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.coalesce(loss, F.lit(1.0))))))
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc(both), "u", element))
    keep = F.when(F.col("mixed"), (F.col("rank") <= F.col("size")) | (both if losses is not None else F.lit(False))).otherwise(F.col("in_a") == 1)
    return x.withColumn("rank", rank).filter(keep).select("candidate", element)


def flip(members: DataFrame, universe: DataFrame, element: str, rate: float | Column, seed: str = "flip-1") -> DataFrame:
    """Bit-flip mutation: each (candidate, element) of ``universe`` changes sides with probability ``rate`` (a number, or a column of ``universe``)."""
    flips = universe.filter(draw(seed, "candidate", element) < rate).select("candidate", element)
    lost = members.join(flips, ["candidate", element], "left_anti")
    return lost.unionByName(flips.join(members, ["candidate", element], "left_anti"))
