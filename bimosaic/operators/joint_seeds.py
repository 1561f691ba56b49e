"""Seeds of additive and multiplicative biclusters: two well-filled rows, the columns that keep their relation, the rows that follow.

For each candidate (candidate, n_rows, n_columns) pairs of the best filled rows are tried in order of the columns both have. A pair
ranks a drawn pool of columns by how far their difference (or ratio) is from the pair's median; the best become the candidate's
columns, all rows are scored by how well they follow the first row of the pair on these, and the best rows are taken. Where a column
then has too few observed cells, rows are swapped until it has enough. Candidates that a pair serves leave the rounds; each round
tries one pair for every candidate that is left, so all rows are scored once a round and candidate, not once a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .fit import residual_scale
from .joint import MULTIPLICATIVE, union
from .prepare import ZERO, required_support
from .seeds import draw

STRONGEST, PAIRS, POOL = 24, 32, 32


def row_pairs(cells: DataFrame, wanted: DataFrame, pattern: str, ratio: float = 0.8, least: int = 2, seed: str = "pair-1") -> DataFrame:
    """candidate, place, first, second, n_columns, n_rows: up to ``PAIRS`` pairs of each candidate's ``STRONGEST`` best filled rows, most usable columns first.

    Only columns that can support the wanted number of rows count. In products the first row's zeros are not usable.
    """
    known = cells.filter("num IS NOT NULL")
    filled = known.groupBy("column_index").agg(F.count(F.lit(1)).alias("support"))
    eligible = wanted.join(filled, F.col("support") >= required_support(F.col("n_rows"), least, ratio)).select("candidate", "column_index", "n_rows", "n_columns")
    per_row = known.join(eligible, "column_index").groupBy("candidate", "row_index").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("n"), "row_index"))
    strong = cut(per_row.withColumn("rank", rank).filter(F.col("rank") <= STRONGEST).select("candidate", "row_index", "rank"), "strong-rows")
    x = known.join(eligible, "column_index").join(strong, ["candidate", "row_index"])
    side = lambda n: x.select("candidate", "column_index", F.col("row_index").alias(n), F.col("rank").alias(f"rank_{n}"), F.col("num").alias(f"v_{n}"))  # noqa: E731  at most STRONGEST rows a candidate and column
    both = side("first").join(side("second"), ["candidate", "column_index"]).filter("rank_first < rank_second")
    if pattern == MULTIPLICATIVE:
        both = both.filter(F.abs("v_first") > ZERO)
    usable = both.groupBy("candidate", "first", "second").agg(F.count(F.lit(1)).alias("usable")).join(wanted, "candidate").filter(F.col("usable") >= F.col("n_columns"))
    place = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("usable"), draw(seed, "candidate", "first", "second"), "first", "second"))
    return usable.withColumn("place", place).filter(F.col("place") <= PAIRS).select("candidate", "place", "first", "second", "n_columns", "n_rows")


def relation_ranking(cells: DataFrame, pairs: DataFrame, stats: DataFrame, pattern: str, pool: int = POOL, ratio: float = 0.8, least: int = 2, seed: str = "pool-1") -> DataFrame:
    """candidate, first, second, column_index, rank, off of the columns in each pair's pool: ``off`` is how far a column's difference
    (over its scale) or ratio is from the pair's median; the smallest index leads equals."""
    key = ["candidate", "first", "second"]
    known = cells.filter("num IS NOT NULL")
    filled = known.groupBy("column_index").agg(F.count(F.lit(1)).alias("support"))
    scale = stats.select("column_index", residual_scale(F.col("robust_range"), F.col("median")).alias("scale"))
    one = pairs.join(known.select(F.col("row_index").alias("first"), "column_index", F.col("num").alias("v")), "first")
    x = one.join(known.select(F.col("row_index").alias("second"), "column_index", F.col("num").alias("w")), ["second", "column_index"])
    x = x.join(filled, "column_index").filter(F.col("support") >= required_support(F.col("n_rows"), least, ratio)).join(scale, "column_index")
    if pattern == MULTIPLICATIVE:
        x = x.filter(F.abs("v") > ZERO).withColumn("relation", F.col("w") / F.col("v")).withColumn("scale", F.lit(1.0))
    else:
        x = x.withColumn("relation", F.col("w") - F.col("v"))
    drawn = F.row_number().over(Window.partitionBy(*key).orderBy(draw(seed, *key, "column_index"), "column_index"))
    x = x.withColumn("drawn", drawn).filter(F.col("drawn") <= F.greatest("n_columns", F.lit(pool)))
    middle = x.groupBy(*key).agg(F.median("relation").alias("middle"))
    off = F.abs(F.col("relation") - F.col("middle")) / F.col("scale")
    x = x.join(middle, key).select(*key, "n_columns", "column_index", off.alias("off"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.round("off", 12), "column_index"))
    return x.withColumn("rank", rank)


def row_scores(cells: DataFrame, columns: DataFrame, anchors: DataFrame, stats: DataFrame, pattern: str, ratio: float = 0.8, least: int = 2) -> DataFrame:
    """candidate, row_index, score, mask: the median distance of every row from the anchor's profile over the candidate's columns.

    ``columns``: candidate, column_index; ``anchors``: candidate, row_index. Profiles are compared after their own medians are taken out
    (divided out in products). ``mask`` has a bit for each observed column, in order. Rows with too few comparable columns have none.
    """
    order = F.row_number().over(Window.partitionBy("candidate").orderBy("column_index")) - 1
    columns = columns.withColumn("bit", order.cast("int")).withColumn("width", F.count(F.lit(1)).over(Window.partitionBy("candidate")))
    scale = stats.select("column_index", residual_scale(F.col("robust_range"), F.col("median")).alias("scale"))
    at = cells.filter("num IS NOT NULL").join(anchors, "row_index").join(columns.select("candidate", "column_index"), ["candidate", "column_index"]).select("candidate", "column_index", F.col("num").alias("anchor"))
    if pattern != MULTIPLICATIVE:
        at = at.join(at.groupBy("candidate").agg(F.median("anchor").alias("m")), "candidate").select("candidate", "column_index", (F.col("anchor") - F.col("m")).alias("anchor"))
    x = cells.filter("num IS NOT NULL").join(columns, "column_index").join(at, ["candidate", "column_index"], "left").join(scale, "column_index")
    usable = F.col("anchor").isNotNull() & (F.abs("anchor") > ZERO) if pattern == MULTIPLICATIVE else F.col("anchor").isNotNull()
    x = x.withColumn("v", F.when(usable, F.col("num") / F.col("anchor")) if pattern == MULTIPLICATIVE else F.col("num"))
    centre = x.groupBy("candidate", "row_index").agg(F.median("v").alias("centre"))
    off = F.abs(F.col("v") - F.col("centre")) if pattern == MULTIPLICATIVE else F.when(usable, F.abs(F.col("v") - F.col("centre") - F.col("anchor")) / F.col("scale"))
    mask = F.expr("bit_or(shiftleft(1L, bit))")
    out = x.join(centre, ["candidate", "row_index"]).groupBy("candidate", "row_index").agg(F.median(off).alias("score"), F.count(off).alias("n"), F.max("width").alias("width"), mask.alias("mask"))
    return out.select("candidate", "row_index", F.when(F.col("n") >= required_support(F.col("width"), least, ratio), F.col("score")).alias("score"), "mask", "width")


def swapped(rows: np.ndarray, scores: np.ndarray, held: np.ndarray, wanted: int, need: int, fixed: int = 2) -> np.ndarray | None:
    """Positions of ``wanted`` rows with the lowest scores whose columns (``held``, a boolean matrix) each have ``need`` observed cells, or None.

    While a column lacks some, the outside row that fills most lacking columns (then the best) comes in for the row whose loss leaves
    the smallest lack (the worst of equals); the ``fixed`` best rows always stay. Each swap reduces the lack, so it ends.
    """
    order = np.lexsort((rows, scores))
    if len(order) < wanted:
        return None
    inside = np.zeros(len(rows), bool)
    inside[order[:wanted]] = True
    counts = held[inside].sum(0)
    lack = lambda c: np.maximum(need - c, 0).sum(-1)
    stays = np.zeros(len(rows), bool)
    stays[order[:fixed]] = True
    while lack(counts) > 0:
        outside = np.flatnonzero(~inside)
        gain = held[outside][:, counts < need].sum(1)
        outside, gain = outside[gain > 0], gain[gain > 0]
        for i in outside[np.lexsort((rows[outside], scores[outside], -gain))]:
            out = np.flatnonzero(inside & ~stays)
            left = lack(counts + held[i] - held[out].astype(int))
            if not len(out) or left.min() >= lack(counts):
                continue
            worst = out[left == left.min()]
            gone = worst[np.lexsort((-rows[worst], -scores[worst]))[0]]
            inside[[gone, i]] = False, True
            counts = counts + held[i] - held[gone].astype(int)
            break
        else:
            return None
    return np.flatnonzero(inside)


def supported_rows(scored: DataFrame, wanted: DataFrame, ratio: float = 0.8, least: int = 2) -> DataFrame:
    """candidate, row_index: as many of the scored rows (candidate, row_index, score, mask, width) as wanted, every column supported; candidates that can't be served have none.

    Of rows with the same observed columns only the best ``n_rows`` can be chosen, so no more of each kind reach a candidate's task.
    """
    full = F.bit_count("mask") >= required_support(F.col("width"), least, ratio)
    x = scored.filter(F.col("score").isNotNull() & full).join(wanted.select("candidate", "n_rows"), "candidate")
    rank = F.row_number().over(Window.partitionBy("candidate", "mask").orderBy("score", "row_index"))
    x = x.withColumn("rank", rank).filter(F.col("rank") <= F.col("n_rows")).withColumn("need", required_support(F.col("n_rows"), least, ratio))

    def run(t: pa.Table) -> pa.Table:
        rows, masks, width, n, need = t["row_index"].to_numpy(), t["mask"].to_numpy(), *(t[c][0].as_py() for c in ("width", "n_rows", "need"))
        held = (masks[:, None] >> np.arange(width) & 1).astype(bool)
        found = swapped(rows, t["score"].to_numpy(), held, n, need)
        return t.select(["candidate", "row_index"]).take(pa.array([] if found is None else found, pa.int64()))

    kinds = dict(x.dtypes)
    return x.select("candidate", "row_index", "score", "mask", "width", "n_rows", "need").groupBy("candidate").applyInArrow(run, f"candidate {kinds['candidate']}, row_index {kinds['row_index']}")


def joint_seeds(cells: DataFrame, wanted: DataFrame, stats: DataFrame, pattern: str, pool: int = POOL, ratio: float = 0.8, least: int = 2, seed: str = "seed-1") -> tuple[DataFrame, DataFrame]:
    """rows (candidate, row_index) and columns (candidate, column_index) of the seeds of ``wanted`` (candidate, n_rows, n_columns; up to 63 columns); candidates no pair serves have none."""
    cells = cut(cells.select("row_index", "column_index", "num"), "seed-cells")
    pairs = cut(row_pairs(cells, wanted, pattern, ratio, least, seed), "seed-pairs")
    rows, columns = [], []
    for k in range(1, PAIRS + 1):
        now = pairs.filter(F.col("place") == k)
        if now.isEmpty():
            break
        ranked = relation_ranking(cells, now.drop("place"), stats, pattern, pool, ratio, least, seed)
        chosen = cut(ranked.filter(F.col("rank") <= F.col("n_columns")).select("candidate", "column_index"), "seed-columns")
        whole = chosen.groupBy("candidate").count().join(wanted, "candidate").filter(F.col("count") == F.col("n_columns")).select("candidate")
        now = now.join(whole, "candidate", "left_semi")
        scored = row_scores(cells, chosen, now.select("candidate", F.col("first").alias("row_index")), stats, pattern, ratio, least).join(now.select("candidate", "first", "second"), "candidate")
        pinned: Column = F.when(F.col("row_index") == F.col("first"), -2.0).when(F.col("row_index") == F.col("second"), -1.0).otherwise(F.col("score"))
        found = cut(supported_rows(scored.withColumn("score", pinned).drop("first", "second"), wanted, ratio, least), "seed-rows")
        done = found.select("candidate").distinct()
        rows.append(found)
        columns.append(chosen.join(done, "candidate", "left_semi"))
        pairs = cut(pairs.join(done, "candidate", "left_anti"), "seed-pairs")
    if not rows:
        none = F.lit(0).cast("long").alias("candidate")
        return cells.select(none, "row_index").limit(0), cells.select(none, "column_index").limit(0)
    return union(rows), union(columns)
