"""Search over candidates: how many each emitter may make, which members of the archive become parents, how rows fit a candidate, and the loop.

Allocation and choice are plans over relations; the loop runs one set of Spark jobs for each batch and cuts its lineage after it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, exists
from . import archive, evaluate, prepare, seeds
from .fit import residual_scale
from .prepare import ZERO

NEW_CELL_REWARD, INSERTION_REWARD = 1.0, 0.25


def credit(outcomes: DataFrame, *keys: str) -> DataFrame:
    """keys, evaluations, accepted, created, credit of (keys, accepted boolean, created boolean): a new cell earns more than a place in an old one."""
    out = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluations"), F.count_if("accepted").alias("accepted"), F.count_if("created").alias("created"))
    return out.withColumn("credit", NEW_CELL_REWARD * F.col("created") + INSERTION_REWARD * (F.col("accepted") - F.col("created")))


def ucb(credits: Column, evaluations: Column, total: Column, exploration: float) -> Column:
    """Mean credit and its upper confidence term; infinite before the first evaluation."""
    n = F.greatest(evaluations, F.lit(1))
    bound = credits / n + exploration * F.sqrt(F.ln(F.greatest(F.lit(2), total + 1).cast("double")) / n)
    return F.when(evaluations > 0, bound).otherwise(F.lit(float("inf")))


def allocate_by_credit(stats: DataFrame, count: int, exploration: float = 0.5, within: str | None = None) -> DataFrame:
    """emitter, allocated: ``count`` places dealt out by upper confidence bound, for each value of ``within`` on its own if given.

    stats: emitter, position (order among equals), evaluations, credit. A place taken lowers the emitter's bound for the next one
    whatever the others take, so the places are the ``count`` highest of all (emitter, places so far) bounds: one ranking, no loop.
    """
    part = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
    keys = [within] if within else []
    slots = stats.withColumn("__total", F.sum("evaluations").over(part)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    slots = slots.withColumn("__s", F.round(ucb(F.col("credit"), F.col("evaluations") + F.col("__k"), F.col("__total"), exploration), 9))
    rank = F.row_number().over(part.orderBy(F.desc("__s"), "position", "__k"))
    taken = slots.withColumn("__rank", rank).filter(F.col("__rank") <= count)
    return taken.groupBy(*keys, "emitter").agg(F.count(F.lit(1)).alias("allocated"))


def allocate_by_share(stats: DataFrame, count: int, scheduler: str = "scheduler") -> DataFrame:
    """scheduler, emitter, allocated: each place goes to the emitter farthest behind its share; stats: scheduler, emitter, position, share, before.

    The few emitters of one scheduler are folded in one array expression; schedulers are independent rows.
    """
    item = F.struct("position", "emitter", "share", F.col("before").cast("double").alias("before"), F.lit(0).cast("long").alias("allocated"))
    rows = stats.groupBy(scheduler).agg(F.array_sort(F.collect_list(item)).alias("state"), F.sum("before").alias("total"))

    def place(state: Column, step: Column) -> Column:
        behind = lambda e: F.round((F.col("total") + step) * e["share"] - e["before"] - e["allocated"], 9)
        most = F.array_max(F.transform(state, behind))
        first = F.array_min(F.transform(F.filter(state, lambda e: behind(e) == most), lambda e: e["position"]))
        return F.transform(state, lambda e: e.withField("allocated", e["allocated"] + (e["position"] == first).cast("long")))

    out = rows.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.col("state"), place))
    return out.select(scheduler, F.explode("state").alias("e")).select(scheduler, "e.emitter", "e.allocated")


def parents(requests: DataFrame, members: DataFrame, pool: int, guided: bool = True, by_cell: bool = True, seed: str = "parent-1") -> DataFrame:
    """request, id: a parent for each request (request) among members (id, cell, loss, signature).

    ``by_cell`` draws an occupied cell first and a pool inside it; otherwise the pool comes from all members (one stratum).
    ``guided`` takes the pool's least loss, otherwise its first draw.
    """
    m = members.select("id", "loss", "signature", F.col("cell").alias("cell") if by_cell else F.lit(0).alias("cell"))
    cells = m.select("cell").distinct().withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cell")))  # occupied cells are few: the grid bounds them
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    asked = requests.select("request").crossJoin(F.broadcast(n))  # one row
    asked = asked.withColumn("at", (F.floor(seeds.draw(seed + ":cell", "request") * F.col("n")) + 1).cast("int")).join(cells, "at").select("request", "cell")
    asked = asked.select("request", F.col("cell").alias("stratum"), F.lit(pool).alias("size"))
    pooled = seeds.first_draws(asked, m.withColumnRenamed("cell", "stratum"), "request", "id", seed)
    key = F.struct("loss", "signature", "id") if guided else F.struct("__u", "id")
    return pooled.groupBy("request").agg(F.min(key).alias("best")).select("request", F.col("best.id").alias("id"))


def mate_pool(mates: DataFrame, pairs: DataFrame, members: DataFrame, pool: int) -> DataFrame:
    """a, b, rank: the ``pool`` best mates of each a among ``mates`` (a, b): most overlap (row and column Jaccard), then rank by loss in their own cell, then signature."""
    local = F.row_number().over(Window.partitionBy("cell").orderBy("loss", "signature"))
    m = members.withColumn("local", local).select(F.col("id").alias("b"), "local", "signature")
    x = mates.join(pairs.select("a", "b", F.round(F.col("row_jaccard") + F.col("column_jaccard"), 9).alias("overlap")), ["a", "b"]).join(m, "b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("overlap"), "local", "signature"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= pool).select("a", "b", "rank")


def least_occupied(targets: DataFrame, group: str) -> DataFrame:
    """group, x, y, n: the reachable cell with the fewest members, the lowest coordinate among equals; targets (group, x, y, n)."""
    return targets.groupBy(group).agg(F.min(F.struct("n", "x", "y")).alias("t")).select(group, "t.x", "t.y", "t.n")


def shapes(bounds: DataFrame, count: int, levels: int, seed: str = "shape-1") -> DataFrame:
    """bound, candidate, n_rows, n_columns: ``count`` shapes of each row of bounds (bound, min_rows, max_rows, min_columns, max_columns).

    Sides take geometric levels; the grid of both is dealt out in a drawn order, again and again until ``count`` shapes are out.
    """

    def level(low: str, high: str) -> Column:
        steps = F.least(F.lit(levels), F.col(high) - F.col(low) + 1)
        inner = F.transform(F.sequence(F.lit(0).cast("long"), (steps - 1).cast("long")), lambda i: F.bround(F.col(low) * F.pow(F.col(high) / F.col(low), i / F.greatest(steps - 1, F.lit(1)))).cast("long"))
        return F.explode(F.array_distinct(F.array_union(inner, F.array(F.col(low).cast("long"), F.col(high).cast("long")))))

    grid = bounds.withColumn("n_rows", level("min_rows", "max_rows")).withColumn("n_columns", level("min_columns", "max_columns")).select("bound", "n_rows", "n_columns")
    rounds = grid.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    order = Window.partitionBy("bound").orderBy("round", seeds.draw(seed, "bound", "round", "n_rows", "n_columns"), "n_rows", "n_columns")
    return rounds.withColumn("candidate", F.row_number().over(order) - 1).filter(F.col("candidate") < count).select("bound", "candidate", "n_rows", "n_columns")


def row_compatibility(cells: DataFrame, rows: DataFrame, fits: DataFrame, stats: DataFrame) -> DataFrame:
    """candidate, row_index, score: mean error of a row under a candidate's column models; infinite where nothing can be compared.

    fits: candidate, column_index, pattern (constant, discrete, additive, multiplicative), parameter (a code for discrete columns).
    Row effects of additive and multiplicative columns are medians over two columns at least.
    """
    scale = stats.select("column_index", "robust_range", residual_scale(F.col("robust_range"), F.col("median")).alias("scale"))
    x = rows.join(fits, "candidate").join(cells.select("row_index", "column_index", "num", "code"), ["row_index", "column_index"]).join(scale, "column_index", "left")
    p, joint = F.col("parameter"), F.col("pattern").isin("additive", "multiplicative")
    ratio = F.when(F.abs(p) > ZERO, F.col("num") / (F.col("scale") * p))
    x = x.withColumn("estimate", F.when(F.col("pattern") == "additive", F.col("num") - p).when(F.col("pattern") == "multiplicative", ratio))
    effects = x.filter(joint).groupBy("candidate", "row_index", "pattern").agg(F.median("estimate").alias("effect"), F.count("estimate").alias("n"))
    x = x.join(effects.filter("n >= 2").drop("n"), ["candidate", "row_index", "pattern"], "left")
    d = F.abs(F.col("num") - p)
    constant = F.when(F.col("robust_range") > ZERO, F.least(F.lit(1.0), d / F.col("robust_range"))).otherwise((d > ZERO).cast("double"))
    error = (
        F.when(F.col("pattern") == "constant", F.when(F.col("num").isNotNull(), constant))
        .when(F.col("pattern") == "discrete", (F.col("code") != p).cast("double"))
        .when(F.col("pattern") == "additive", F.when(F.col("num").isNotNull() & F.col("effect").isNotNull(), F.least(F.lit(1.0), F.abs(F.col("num") - F.col("effect") - p) / F.col("scale"))))
        .otherwise(F.when((F.col("robust_range") > ZERO) & F.col("num").isNotNull() & F.col("effect").isNotNull(), F.least(F.lit(1.0), F.abs(F.col("num") / F.col("robust_range") - F.col("effect") * p))))
    )
    return x.groupBy("candidate", "row_index").agg(F.coalesce(F.avg(error), F.lit(float("inf"))).alias("score"))


def evidence_deficit(error: Column, reference: Column, threshold: float) -> Column:
    """The error of a joint model that has no constant model to fall back on: at least its lack of improvement over the reference."""
    if threshold == 0:
        return error
    return F.greatest(error, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (threshold - (reference - error)) / threshold)))


def model_margins(alternatives: DataFrame) -> DataFrame:
    """candidate, column_index, margin, equivalents, ambiguous of the chosen model against the others (pattern, error, chosen); no row without a rival."""
    keys = ["candidate", "column_index"]
    chosen = alternatives.filter("chosen").select(*keys, F.col("pattern").alias("own"), F.col("error").alias("own_error"))
    rivals = alternatives.filter("NOT chosen").join(chosen, keys).filter("pattern <> own")
    near = F.when(F.abs(F.col("error") - F.col("own_error")) <= ZERO, F.col("pattern"))
    out = rivals.groupBy(*keys, "own", "own_error").agg(F.min("error").alias("best"), F.collect_set(near).alias("near"))
    out = out.withColumn("equivalents", F.array_join(F.array_sort(F.array_union("near", F.array("own"))), ","))
    return out.select(*keys, (F.col("best") - F.col("own_error")).alias("margin"), "equivalents", (F.size("near") > 0).alias("ambiguous"))


def _digest(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """candidate, signature, n_rows, n_columns without gathering members: sums and XORs of element hashes are equal for equal sets."""
    side = lambda x, e, n: x.groupBy("candidate").agg(F.count(F.lit(1)).alias(n), F.bit_xor(F.xxhash64(e)).alias(f"x_{n}"), F.sum(F.xxhash64(e, F.lit(7)).cast("decimal(38,0)")).alias(f"s_{n}"))
    out = side(rows, "row_index", "n_rows").join(side(columns, "column_index", "n_columns"), "candidate")
    parts = [F.col(f"{k}_{n}").cast("string") for n in ("n_rows", "n_columns") for k in ("x", "s")]
    return out.select("candidate", "n_rows", "n_columns", F.sha2(F.concat_ws(":", "n_rows", "n_columns", *parts), 256).alias("signature"))


STATE = "step long, evaluated long, fingerprint string, place string"


def save_state(checkpoint: str, step: int, evaluated: int, fingerprint: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a step, then its entry in the log of steps: a step without an entry never was."""
    spark = next(iter(tables.values())).sparkSession
    place = f"{checkpoint.rstrip('/')}/steps/{step:06d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
    entry = spark.createDataFrame([(step, evaluated, fingerprint, place)], STATE).coalesce(1)
    entry.write.mode("append").parquet(f"{checkpoint.rstrip('/')}/log")


def load_state(spark: SparkSession, checkpoint: str, fingerprint: str) -> tuple[int, int, dict[str, DataFrame]] | None:
    """Step, evaluations and tables of the last step at ``checkpoint``; None if there is none. Another fingerprint is refused."""
    log = f"{checkpoint.rstrip('/')}/log"
    if not exists(spark, log):
        return None
    last = spark.read.schema(STATE).parquet(log).orderBy(F.desc("step"), "place").first()
    if last is None:
        return None
    if last["fingerprint"] != fingerprint:
        raise ValueError(f"{checkpoint} belongs to a search over other cells or with other settings")
    return last["step"], last["evaluated"], {name: spark.read.parquet(f"{last['place']}/{name}") for name in ("archive", "row_index", "column_index")}


def _fingerprint(cells: DataFrame, settings: dict) -> str:
    whole = cells.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row_index", "column_index", "num", "code")).alias("x"), F.sum(F.xxhash64("code", "num", "column_index", "row_index").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([settings, str(tuple(whole))], sort_keys=True).encode()).hexdigest()


def search(
    cells: DataFrame, batch: int = 16, generations: int = 3, n_rows: int = 12, n_columns: int = 4, bins: int = 4, capacity: int = 4, rate: float = 0.02, max_coherence: float = 0.30,
    seed: str = "search-1", budget: int | None = None, patterns: tuple[str, ...] = ("constant",), checkpoint: str | None = None,
) -> DataFrame:
    """The archive after ``budget`` evaluations (``generations`` batches, if not given): candidate, generation, cell, signature, n_rows, n_columns, coherence, contrast, violation.

    The first batch is drawn at random, with shapes up to four times ``n_rows`` and ``n_columns``; later ones cross two parents of drawn
    cells and flip ``rate`` times their size of rows and columns, in or out, as expected. The grid spans all sizes the table allows. All of a batch is scored in one
    plan (``patterns`` other than constant: by the mixed assignment), and enters the archive cell by cell in candidate order; the last
    batch is as large as the budget leaves. The same seed gives the same archive. An empty table gives none.

    With a ``checkpoint`` folder each batch ends with its archive and members written there and one entry in a log. A search with
    the same cells and settings goes on after the last entry, to the same archive as one that was never stopped (if it stopped after whole
    batches); the budget may be another. With other cells or settings it is refused.
    """
    spark = cells.sparkSession
    budget = generations * batch if budget is None else budget
    cells = cut(cells.select("row_index", "column_index", "num", "code"), "search-cells")
    stats = cut(prepare.column_stats(cells, by_ranges=True), "search-stats")
    every = {e: cut(cells.select(e).distinct().withColumn("stratum", F.lit(0)), f"search-{e}") for e in ("row_index", "column_index")}
    total = {e: x.count() for e, x in every.items()}
    sizes = {"row_index": "n_rows", "column_index": "n_columns"}
    most = {e: max(2, min(4 * n, total[e])) for e, n in (("row_index", n_rows), ("column_index", n_columns))}
    bounds = spark.range(1).select(F.lit(0).alias("bound"), *[F.lit(v).cast("long").alias(f"{k}_{n}") for n, v_ in (("rows", most["row_index"]), ("columns", most["column_index"])) for k, v in (("min", 2), ("max", v_))])
    first = shapes(bounds, batch, bins, f"{seed}:shape")
    members: dict[str, DataFrame] = {}
    kept, g, evaluated = None, 0, 0
    if checkpoint:
        settings = {"batch": batch, "n_rows": n_rows, "n_columns": n_columns, "bins": bins, "capacity": capacity, "rate": rate, "max_coherence": max_coherence, "seed": seed, "patterns": list(patterns)}
        fingerprint = _fingerprint(cells, settings)
        found = load_state(spark, checkpoint, fingerprint)
        if found is not None:
            g, evaluated, tables = found[0] + 1, found[1], found[2]
            kept, members = tables.pop("archive"), tables
    while evaluated < budget:
        count = min(batch, budget - evaluated)
        new = spark.range(g * batch, g * batch + count).select(F.col("id").alias("candidate"))
        made: dict[str, DataFrame] = {}
        if kept is not None:
            pool = kept.withColumn("loss", (F.col("loss1") + F.col("loss2")) / 2).withColumn("id", F.col("candidate"))
            ask = new.select(F.col("candidate").alias("request"))
            a, b = (parents(ask, pool, 2, guided, seed=f"{seed}:{g}:{guided}").select(F.col("request").alias("candidate"), F.col("id").alias(n)) for n, guided in (("a", True), ("b", False)))
            pairs = cut(a.join(b, "candidate"), "search-pairs")
            new = pairs.select("candidate")
        for e, side in sizes.items():
            if kept is None:
                drawn = new.join(first.select(F.col("candidate").cast("long").alias("candidate"), F.col(side).alias("size")), "candidate")
                fresh = seeds.random_members(drawn.withColumn("stratum", F.lit(0)), every[e], e, f"{seed}:{e}")
            else:
                crossed = seeds.crossover(pairs, members[e].withColumnRenamed("candidate", "id"), e, f"{seed}:{g}:{e}")
                share = crossed.groupBy("candidate").agg((rate * F.count(F.lit(1)) / total[e]).alias("share"))
                universe = share.withColumn("stratum", F.lit(0)).join(every[e], "stratum").select("candidate", e, "share")
                fresh = seeds.flip(crossed, universe, e, F.col("share"), f"{seed}:{g}:flip:{e}")
            made[e] = cut(fresh, f"search-{e}")
        rows, columns = made["row_index"], made["column_index"]
        shape = _digest(rows, columns).filter("n_rows >= 2 AND n_columns >= 2")
        rows, columns = (x.join(shape.select("candidate"), "candidate", "left_semi") for x in (rows, columns))
        scored = _scores(cells, rows, columns, stats, patterns, max_coherence).join(shape, "candidate")
        cell = archive.geometric_bin(F.col("n_rows"), 2, max(3, total["row_index"]), bins) * bins + archive.linear_bin(F.col("n_columns"), 2, max(3, total["column_index"]), bins)
        scored = scored.select("candidate", F.lit(g).alias("generation"), cell.cast("long").alias("cell"), "signature", "n_rows", "n_columns", "coherence", "contrast", "violation", F.col("coherence").alias("loss1"), (1 - F.col("contrast")).alias("loss2"), "valid")
        together = cut(scored if kept is None else kept.withColumn("valid", F.lit(True)).unionByName(scored), "search-scored")
        status = archive.insert_fold(together.withColumn("sequence", F.col("candidate")), capacity)
        kept = cut(together.drop("valid").join(archive.survivors(status).withColumnRenamed("sequence", "candidate"), "candidate", "left_semi"), "search-archive")
        for e in sizes:
            both = made[e] if e not in members else members[e].unionByName(made[e])
            members[e] = cut(both.join(kept.select("candidate"), "candidate", "left_semi"), f"search-members-{e}")
        evaluated += count
        if checkpoint:
            save_state(checkpoint, g, evaluated, fingerprint, {"archive": kept, **members})
        g += 1
    if kept is None:
        raise ValueError("a search needs a budget of one evaluation at least")
    return kept.drop("loss1", "loss2")


def _scores(cells: DataFrame, rows: DataFrame, columns: DataFrame, stats: DataFrame, patterns: tuple[str, ...], max_coherence: float) -> DataFrame:
    """candidate, coherence, contrast, violation, valid of a batch."""
    if tuple(patterns) == ("constant",):
        out = evaluate.evaluate_constant(cells, rows, columns, stats, max_coherence=max_coherence)
        return out.select("candidate", "coherence", "contrast", "violation", F.lit(True).alias("valid"))
    from . import scoring  # which builds on this module

    found = scoring.evaluate_biclusters(cells, rows, columns, patterns, stats, max_coherence=max_coherence).summary
    return found.filter("coherence IS NOT NULL").select("candidate", "coherence", "contrast", "violation", "valid")
