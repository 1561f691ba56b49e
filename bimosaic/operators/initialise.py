"""First candidates of a search: shapes dealt to patterns and grown from seeds, and a plan that visits every reachable archive cell.

The plan is a table of states, one row for each cell and slot (the pattern its seed is to follow), with the attempts made. Whichever
cells have been tried least come next, one slot a cell, so all are visited before any is tried again; a cell is done when its slots
are made or its attempts are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import fit, joint_seeds, seeds
from .assignment import CONSTANT
from .joint import union
from .prepare import required_support
from .search import shapes

SEEDS_PER_CELL, MOST_ATTEMPTS = 4, 12


def pattern_requests(bounds: DataFrame, count: int, patterns: tuple[str, ...], levels: int = 8, seed: str = "shape-1") -> DataFrame:
    """candidate, pattern, n_rows, n_columns: ``count`` shapes (``search.shapes``), the patterns taking turns."""
    turn = F.element_at(F.array(*map(F.lit, patterns)), (F.col("candidate") % len(patterns) + 1).cast("int"))
    return shapes(bounds, count, levels, seed).select(F.col("candidate").cast("long").alias("candidate"), turn.alias("pattern"), "n_rows", "n_columns")


def constant_seeds(cells: DataFrame, wanted: DataFrame, stats: DataFrame, ratio: float = 0.8, least: int = 2, seed: str = "anchor-1") -> tuple[DataFrame, DataFrame]:
    """rows and columns of constant seeds: the rows nearest to a drawn anchor, then the numeric columns that fit them best."""
    known = cells.filter("num IS NOT NULL")
    filled = known.groupBy("column_index").agg(F.count(F.lit(1)).alias("support"))
    eligible = cut(wanted.join(filled, F.col("support") >= required_support(F.col("n_rows"), least, ratio)).select("candidate", "column_index"), "eligible")
    full = known.groupBy("row_index").agg(F.count(F.lit(1)).alias("n"))
    pool = full.join(full.agg(F.max("n").alias("most")), F.col("n") >= F.col("most") * ratio).select("row_index")  # well-filled rows
    drawn = F.min_by("row_index", F.struct(seeds.draw(seed, "candidate", "row_index"), "row_index"))
    some = pool.orderBy(seeds.draw(seed, "row_index"), "row_index").limit(joint_seeds.STRONGEST)  # rows that anchors come from
    anchors = cut(wanted.select("candidate").crossJoin(F.broadcast(some)).groupBy("candidate").agg(drawn.alias("row_index")), "anchors")
    near = seeds.nearest_rows(cells, anchors, eligible, stats, 1 << 30).join(wanted.select("candidate", "n_rows"), "candidate")
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy("distance", "row_index"))
    rows = cut(near.withColumn("rank", rank).filter(F.col("rank") <= F.col("n_rows")).select("candidate", "row_index"), "seed-rows")
    fits = fit.constant_fit_numeric(fit.submatrix(cells, rows, eligible), stats, ratio).join(wanted.select("candidate", "n_columns"), "candidate")
    best = F.row_number().over(Window.partitionBy("candidate").orderBy(F.round("error", 9), "column_index"))
    columns = fits.withColumn("rank", best).filter(F.col("rank") <= F.col("n_columns")).select("candidate", "column_index")
    return rows, cut(columns, "seed-columns")


def grow(cells: DataFrame, requests: DataFrame, stats: DataFrame, pool: int = joint_seeds.POOL, ratio: float = 0.8, least: int = 2, seed: str = "grow-1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows, columns and made (candidate, pattern, n_rows, n_columns as they came out) of requests (candidate, pattern, n_rows, n_columns).

    A request that no seed of its pattern can serve in full is not made.
    """
    requests = cut(requests.select("candidate", "pattern", "n_rows", "n_columns"), "requests")
    rows, columns = [], []
    for (pattern,) in sorted(requests.select("pattern").distinct().collect()):
        own = requests.filter(F.col("pattern") == pattern).drop("pattern")
        make = (constant_seeds(cells, own, stats, ratio, least, seed) if pattern == CONSTANT
                else joint_seeds.joint_seeds(cells, own, stats, pattern, pool, ratio, least, seed))
        rows.append(make[0])
        columns.append(make[1])
    if not rows:
        return requests.select("candidate").limit(0).withColumn("row_index", F.lit(0).cast("long")), requests.select("candidate").limit(0).withColumn("column_index", F.lit(0)), requests
    r, c = union(rows), union(columns)
    size = lambda df, n: df.groupBy("candidate").agg(F.count(F.lit(1)).alias(n))
    made = requests.join(size(r, "r"), "candidate").join(size(c, "c"), "candidate").filter("r = n_rows AND c = n_columns").drop("r", "c")
    made = cut(made, "made")
    return r.join(made.select("candidate"), "candidate", "left_semi"), c.join(made.select("candidate"), "candidate", "left_semi"), made


def coverage_plan(targets: DataFrame, patterns: tuple[str, ...], seeds_per_cell: int = SEEDS_PER_CELL) -> DataFrame:
    """States (the columns of ``targets``, slot, pattern, attempts, made) of all reachable cells (cell, ...): slots take the patterns in turn, each has one at least."""
    if seeds_per_cell < len(patterns):
        raise ValueError("a cell needs as many seeds as there are patterns")
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(patterns[k % len(patterns)]).alias("pattern")) for k in range(seeds_per_cell)])).alias("s")
    return targets.select("*", slots).select(*targets.columns, "s.*").withColumn("attempts", F.lit(0).cast("long")).withColumn("made", F.lit(False))


def next_targets(states: DataFrame, count: int, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The next ``count`` states to try: of every open cell its open slot with the fewest attempts, the cells with the fewest attempts first."""
    per = states.groupBy("cell").agg(F.sum("attempts").alias("tried"))
    open_ = states.filter("NOT made").join(per.filter(F.col("tried") < most_attempts), "cell")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("attempts", "slot"))
    return open_.withColumn("rank", rank).filter("rank = 1").drop("rank").orderBy("tried", "cell").limit(count).drop("tried")


def recorded(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``states`` after attempts (cell, slot, hit: the seed entered its cell)."""
    new = outcomes.groupBy("cell", "slot").agg(F.count(F.lit(1)).alias("more"), F.max("hit").alias("hit"))
    out = states.join(new, ["cell", "slot"], "left")
    return out.withColumn("attempts", F.col("attempts") + F.coalesce("more", F.lit(0))).withColumn("made", F.col("made") | F.coalesce("hit", F.lit(False))).select(*states.columns)
