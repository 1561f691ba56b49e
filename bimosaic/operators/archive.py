"""Grid binning, dominance, crowding and the bounded archive."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Distinct points of a cell in a block of the skyline.
POINTS = 20_000


def linear_bin(v: Column, low: float, high: float, bins: int) -> Column:
    """0 .. bins - 1, null outside [low, high]."""
    return F.when((v >= low) & (v <= high), F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins))).cast("int")


def geometric_bin(v: Column, low: float, high: float, bins: int) -> Column:
    at = F.floor(F.ln(v / low) / F.ln(F.lit(high / low)) * bins)
    return F.when((v >= low) & (v <= high), F.least(F.lit(bins - 1), at)).cast("int")


def custom_bin(v: Column, bounds: list[float]) -> Column:
    """Number of inner boundaries at or below v."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= v))


def exact_bin(v: Column, low: int) -> Column:
    return F.when(v == F.round(v), F.round(v) - low).cast("int")


def pareto_front(candidates: DataFrame, *losses: str, cell: str = "cell") -> DataFrame:
    """Candidates that no other one of the cell dominates; a null loss is the worst. Two losses need one sort, more a skyline of blocks."""
    return _front_of_two(candidates, *losses, cell=cell) if len(losses) == 2 else _skyline(candidates, list(losses), cell)


def _front_of_two(candidates: DataFrame, loss1: str, loss2: str, cell: str) -> DataFrame:
    peers = Window.partitionBy(cell, loss1)
    steps = candidates.groupBy(cell, loss1).agg(F.min(loss2).alias("__least"))
    before = Window.partitionBy(cell).orderBy(loss1).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("__before", F.min("__least").over(before)).drop("__least")
    out = candidates.withColumn("__peer", F.min(loss2).over(peers)).join(steps, [cell, loss1])
    dominated = (F.col("__peer") < F.col(loss2)) | F.coalesce(F.col("__before") <= F.col(loss2), F.lit(False))
    return out.filter(~dominated).drop("__peer", "__before")


def undominated(x: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """Which of the distinct rows no row of ``by`` (itself, if not given) dominates. In order of the sum of losses a row can only be dominated by earlier ones, and it is enough to ask those that stay."""
    keep = np.ones(len(x), bool)
    if by is not None:
        for i, row in enumerate(x):
            keep[i] = not ((by <= row).all(1) & (by < row).any(1)).any()
        return keep
    front = np.empty_like(x)
    n = 0
    for i in np.argsort(x.sum(1), kind="stable"):
        f = front[:n]
        keep[i] = not ((f <= x[i]).all(1) & (f < x[i]).any(1)).any()
        if keep[i]:
            front[n] = x[i]
            n += 1
    return keep


def _skyline(candidates: DataFrame, losses: list[str], cell: str) -> DataFrame:
    """Fronts of blocks of distinct points, then every block's front against that of every other of the cell: what dominates a point is on its own block's front or dominated by one that is."""
    names = [f"l{k}" for k in range(len(losses))]
    bad = float("inf")
    points = candidates.select(F.col(cell).alias("c"), *[F.coalesce(F.col(x).cast("double"), F.lit(bad)).alias(n) for x, n in zip(losses, names)]).distinct()
    points = cut(points, "points")
    parts = points.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / POINTS).cast("int").alias("parts"))
    dealt = points.alias("p").join(parts.alias("q"), F.expr("p.c <=> q.c")).select("p.c", *names, F.pmod(F.xxhash64(*names), "parts").cast("int").alias("k"), "parts")
    schema = ", ".join(f"{n} {k}" for n, k in dealt.dtypes)
    matrix = lambda t: np.column_stack([t[n].to_numpy() for n in names])

    def local(t: pa.Table) -> pa.Table:
        return t.filter(pa.array(undominated(matrix(t))))

    fronts = cut(dealt.groupBy("c", "k").applyInArrow(local, schema), "fronts")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    met = fronts.filter("parts > 1").select("*", other).filter("o <> k").withColumns({"x": F.least("k", "o"), "y": F.greatest("k", "o")})

    def lost(t: pa.Table) -> pa.Table:
        own = t["k"].to_numpy() == t["x"].to_numpy()
        v, gone = matrix(t), np.zeros(len(t), bool)
        gone[own], gone[~own] = ~undominated(v[own], v[~own]), ~undominated(v[~own], v[own])
        return t.filter(pa.array(gone)).select(["c", *names])

    kinds = dict(dealt.dtypes)
    gone = met.groupBy("c", "x", "y").applyInArrow(lost, ", ".join(f"{n} {kinds[n]}" for n in ("c", *names))).distinct()
    same = lambda a, b: functools.reduce(lambda p, q: p & q, [a[n].eqNullSafe(b[n]) for n in ("c", *names)])
    front = cut(fronts.select("c", *names).join(gone, same(fronts, gone), "left_anti"), "front")
    on = [candidates[cell].eqNullSafe(front["c"])] + [F.coalesce(candidates[x].cast("double"), F.lit(bad)) == front[n] for x, n in zip(losses, names)]
    return candidates.join(front, functools.reduce(lambda p, q: p & q, on), "left_semi")


def constrained_front(candidates: DataFrame, *losses: str, cell: str = "cell") -> DataFrame:
    """Feasible before infeasible, less violation before more, then the Pareto front; needs ``violation``."""
    least = Window.partitionBy(cell)
    best = candidates.withColumn("__v", F.min(F.greatest("violation", F.lit(0.0))).over(least)).filter(F.greatest("violation", F.lit(0.0)) == F.col("__v")).drop("__v")
    return pareto_front(best, *losses, cell=cell)


def crowding(members: DataFrame, losses: list[str], cell: str = "cell", key: str = "id") -> DataFrame:
    """``crowding``: per loss the gap between the neighbours over the cell's range, infinite at the ends."""
    whole = Window.partitionBy(cell)
    out, parts = members, []
    for loss in losses:
        order = Window.partitionBy(cell).orderBy(loss, key)
        span = F.max(loss).over(whole) - F.min(loss).over(whole)
        gap = (F.lead(loss).over(order) - F.lag(loss).over(order)) / F.when(span > 1e-15, span)
        out = out.withColumn(f"__{loss}", F.when(span <= 1e-15, 0.0).otherwise(F.coalesce(gap, F.lit(float("inf")))))
        parts.append(F.col(f"__{loss}"))
    return out.withColumn("crowding", sum(parts, F.lit(0.0))).drop(*[f"__{x}" for x in losses])


def top_k_per_cell(members: DataFrame, order: list[Column], k: int, cell: str = "cell") -> DataFrame:
    return members.withColumn("rank", F.row_number().over(Window.partitionBy(cell).orderBy(*order))).filter(F.col("rank") <= k)


STATUSES = ("INSERTED", "INSERTED_WITH_EVICTIONS", "REJECTED_INVALID", "REJECTED_OUT_OF_BOUNDS", "REJECTED_DUPLICATE", "REJECTED_DOMINATED", "REJECTED_CAPACITY")


def _dominates(a: dict, b: dict) -> bool:
    va, vb = max(a["violation"], 0), max(b["violation"], 0)
    if va != vb:
        return va < vb
    return a["loss1"] <= b["loss1"] and a["loss2"] <= b["loss2"] and (a["loss1"] < b["loss1"] or a["loss2"] < b["loss2"])


def _crowds(rows: list[dict]) -> dict[str, float]:
    out = {r["signature"]: 0.0 for r in rows}
    for loss in ("loss1", "loss2"):
        s = sorted(rows, key=lambda r: (r[loss], r["signature"]))
        span = s[-1][loss] - s[0][loss]
        if span <= 1e-15:
            continue
        for k, r in enumerate(s):
            out[r["signature"]] += float("inf") if k in (0, len(s) - 1) else (s[k + 1][loss] - s[k - 1][loss]) / span
    return out


def insert_fold(candidates: DataFrame, capacity: int = 8) -> DataFrame:
    """Outcome of every insertion in order of ``sequence``: cell, sequence, status, created_cell, evicted (sequences it drove out).

    Columns: cell, sequence, signature, loss1, loss2, violation, valid; a null cell is out of bounds. What enters a cell depends on
    what came before, so cells are folded one by one; a cell holds ``capacity`` members, the least crowded survive, and the largest
    signature goes first among equals. Invalid candidates and those out of bounds never reach the fold. A member evicted later
    keeps the outcome of its own insertion.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        out = []
        for r in pdf.sort_values("sequence").to_dict("records"):
            status, created, gone = "INSERTED", not kept, []
            if any(k["signature"] == r["signature"] for k in kept):
                status = "REJECTED_DUPLICATE"
            elif any(_dominates(k, r) for k in kept):
                status = "REJECTED_DOMINATED"
            else:
                gone = [k for k in kept if _dominates(r, k)]
                now = [k for k in kept if k not in gone] + [r]
                if len(now) > capacity:
                    crowd = _crowds(now)
                    low = min(crowd.values())
                    victim = max((k for k in now if crowd[k["signature"]] == low), key=lambda k: k["signature"])
                    now.remove(victim)
                    if victim is r:
                        status, now, gone = "REJECTED_CAPACITY", kept, []
                    else:
                        gone.append(victim)
                kept = now
                if gone:
                    status = "INSERTED_WITH_EVICTIONS"
            out.append((r["cell"], r["sequence"], status, created, [k["sequence"] for k in gone]))
        return pd.DataFrame(out, columns=["cell", "sequence", "status", "created_cell", "evicted"])

    schema = "cell long, sequence long, status string, created_cell boolean, evicted array<long>"
    rows = candidates.select(F.col("cell").cast("long").alias("cell"), F.col("sequence").cast("long").alias("sequence"), "signature", "loss1", "loss2", "violation", F.coalesce("valid", F.lit(False)).alias("valid"))
    bad = F.when(~F.col("valid"), "REJECTED_INVALID").otherwise("REJECTED_OUT_OF_BOUNDS")
    refused = rows.filter("NOT valid OR cell IS NULL").select("cell", "sequence", bad.alias("status"), F.lit(False).alias("created_cell"), F.array().cast("array<long>").alias("evicted"))
    return rows.filter("valid AND cell IS NOT NULL").groupBy("cell").applyInPandas(run, schema).unionByName(refused)


def survivors(outcomes: DataFrame) -> DataFrame:
    """sequence of the members that are left after all of ``outcomes``."""
    entered = outcomes.filter(F.col("status").startswith("INSERTED")).select("sequence")
    return entered.join(outcomes.select(F.explode("evicted").alias("sequence")), "sequence", "left_anti")


def bin_bounds(bins: DataFrame, low: str, high: str, count: str, geometric: bool = False) -> DataFrame:
    """bin, from, to, representative of every bin of the axes in ``bins``: equal steps, or equal ratios with the geometric mean in the middle."""
    x = bins.select("*", F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))).alias("bin"))
    if geometric:
        edge = lambda k: F.col(low) * F.pow(F.col(high) / F.col(low), (F.col("bin") + k) / F.col(count))
        return x.select("*", edge(0).alias("from"), edge(1).alias("to"), edge(0.5).alias("representative"))
    edge = lambda k: F.col(low) + (F.col(high) - F.col(low)) * (F.col("bin") + k) / F.col(count)
    return x.select("*", edge(0).alias("from"), edge(1).alias("to"), edge(0.5).alias("representative"))


def cell_targets(occupied: DataFrame, bins: list[int]) -> DataFrame:
    """All reachable cells (x, y) with their occupancy, the emptiest first by coordinate."""
    spark = occupied.sparkSession
    grid = spark.range(bins[0] * bins[1]).select((F.col("id") / bins[1]).cast("int").alias("x"), (F.col("id") % bins[1]).cast("int").alias("y"))
    counts = occupied.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))
