"""Alternating local search: one guided membership move a parent, rows and columns in turn along a lineage.

What a parent came from decides the next move: after a row move columns follow, after a column move rows; parents from elsewhere start
by the parity of their sequence. Where the preferred side allows no move, the other one moves. Swaps, which keep the size, are drawn
unless the draw falls under ``change``; then the side grows or shrinks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import moves
from .joint import union
from .seeds import draw

NAME = "alternating_pattern_local_search"
CHANGE = 0.25
SIDES = {"rows": "row_index", "columns": "column_index"}


def local_plan(parents: DataFrame, sizes: DataFrame, minimum: tuple[int, int] = (2, 2), change: float = CHANGE, seed: str = "local-1") -> DataFrame:
    """candidate, side, operation: the move of each parent (candidate, producer, operation, sequence); none where no side can move.

    ``sizes``: candidate, n_rows, n_columns, all_rows, all_columns. A side can be added to and swapped while it is not the whole, and
    shrunk while it is above its minimum.
    """
    last = F.when(F.col("producer") == NAME, F.col("last"))
    turn = F.when(last.endswith("_row"), "columns").when(last.endswith("_column"), "rows").when(F.col("sequence") % 2 == 0, "rows").otherwise("columns")
    x = parents.select("candidate", "producer", F.col("operation").alias("last"), "sequence").join(sizes, "candidate").withColumn("turn", turn)
    can = {}
    for (side, _), least in zip(SIDES.items(), minimum):
        grow, shrink = F.col(f"n_{side}") < F.col(f"all_{side}"), F.col(f"n_{side}") > least
        can[side] = grow, shrink
    able = {side: grow | shrink for side, (grow, shrink) in can.items()}
    side = F.when(F.when(F.col("turn") == "rows", able["rows"]).otherwise(able["columns"]), F.col("turn")).when(able["rows"], "rows").when(able["columns"], "columns")
    x = x.withColumn("side", side).filter("side IS NOT NULL")
    grow, shrink = (F.when(F.col("side") == "rows", can["rows"][k]).otherwise(can["columns"][k]) for k in (0, 1))
    u, v = draw(f"{seed}:kind", "candidate", "sequence"), draw(f"{seed}:way", "candidate", "sequence")
    way = F.when(grow & shrink, F.when(v < 0.5, "add").otherwise("remove")).when(grow, "add").otherwise("remove")
    return x.select("candidate", "side", F.when(grow & (u >= change), "swap").otherwise(way).alias("operation"))


def local_step(
    parents: DataFrame, members: dict[str, DataFrame], universes: dict[str, DataFrame], losses: dict[str, Callable[[DataFrame], DataFrame]],
    minimum: tuple[int, int] = (2, 2), change: float = CHANGE, pool: int = 64, seed: str = "local-1",
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Offspring of all parents at once: members by side (candidate, element; the parent's number stays) and lineage (candidate, producer, operation).

    ``members``, ``universes`` and ``losses`` (as ``moves.guided_move`` takes them) are given for "rows" and "columns".
    """
    n = {side: members[side].groupBy("candidate").agg(F.count(F.lit(1)).alias(f"n_{side}")) for side in SIDES}
    whole = {side: universes[side].agg(F.count(F.lit(1)).alias(f"all_{side}")) for side in SIDES}
    sizes = n["rows"].join(n["columns"], "candidate").crossJoin(F.broadcast(whole["rows"])).crossJoin(F.broadcast(whole["columns"]))  # one row each
    plan = cut(local_plan(parents, sizes, minimum, change, seed), "local-plan")
    out = {}
    for (side, element), least in zip(SIDES.items(), minimum):
        own = members[side].select("candidate", F.col(element).cast("long").alias(element))
        parts = [own.join(plan.filter(F.col("side") != side), "candidate", "left_semi")]
        for operation in moves.OPERATIONS:
            some = own.join(plan.filter((F.col("side") == side) & (F.col("operation") == operation)), "candidate", "left_semi")
            parts.append(moves.guided_move(some, universes[side], element, operation, losses[side], least, pool, f"{seed}:{operation}"))
        out[side] = cut(union(parts), f"local-{side}")
    one = F.when(F.col("side") == "rows", "row").otherwise("column")
    return out, plan.select("candidate", F.lit(NAME).alias("producer"), F.concat_ws("_", "operation", one).alias("operation"))
