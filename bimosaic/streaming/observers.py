"""Run metrics as (window, metric, value): distributions of evaluated values, their faults, and snapshots of the archive.

Windows hold ``every`` evaluations each, as in ``events``. Outcomes are (step, id, cell, status, evicted: ids driven out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .events import cadence

RETAINED = ("INSERTED", "INSERTED_WITH_EVICTIONS")
STATISTICS = ("minimum", "first_quartile", "median", "mean", "third_quartile", "maximum")
QUARTERS = (0.25, 0.5, 0.75)
#: Ranges that the values of a name are numbered in; bits of a place read at once.
_RANGES, _DIGIT = 64, 5


def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
    return df.select("window", F.explode(pairs).alias("m")).select("window", "m.metric", "m.value")


def distributions(values: DataFrame, prefix: str) -> DataFrame:
    """Six statistics per window and name of ``values`` (window, name, value); a name without values in a window has none."""
    p = F.percentile("value", F.array(*map(F.lit, QUARTERS)))
    s = values.filter("value IS NOT NULL").groupBy("window", "name").agg(F.min("value").alias("minimum"), p.alias("q"), F.avg("value").alias("mean"), F.max("value").alias("maximum"))
    s = s.select("window", "name", "minimum", F.col("q")[0].alias("first_quartile"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("third_quartile"), "maximum")
    return _six(s, prefix)


def _six(s: DataFrame, prefix: str) -> DataFrame:
    long = s.unpivot(["window", "name"], list(STATISTICS), "statistic", "value")
    return long.select("window", F.concat_ws(".", F.lit(prefix), "name", "statistic").alias("metric"), "value")


def evaluated(values: DataFrame, every: int, prefix: str) -> DataFrame:
    """Distribution of the objectives or descriptors (step, name, value) evaluated in each window."""
    return distributions(values.withColumn("window", cadence(F.col("step"), every)), prefix)


def issues(evaluations: DataFrame, every: int) -> DataFrame:
    """Valid and invalid rate of each window and the share of candidates with each issue; evaluations (step, issues: array, null or empty if valid)."""
    x = evaluations.select(cadence(F.col("step"), every).alias("window"), F.array_distinct(F.coalesce("issues", F.array().cast("array<string>"))).alias("issues"))
    n = x.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("issues") > 0).alias("bad"))
    codes = x.select("window", F.explode("issues").alias("code")).groupBy("window", "code").agg(F.count(F.lit(1)).alias("k")).join(n, "window")
    rates = _long(n, {"evaluation.valid_rate": (F.col("n") - F.col("bad")) / F.col("n"), "evaluation.invalid_rate": F.col("bad") / F.col("n")})
    name = F.concat(F.lit("evaluation.issue."), F.lower("code"), F.lit(".candidate_rate"))
    return rates.unionByName(codes.select("window", name.alias("metric"), (F.col("k") / F.col("n")).alias("value")))


def stays(outcomes: DataFrame, every: int) -> DataFrame:
    """id, cell, first, last window at whose end each member is in the archive; the last window with an outcome ends all that are not driven out."""
    x = outcomes.withColumn("window", cadence(F.col("step"), every))
    into = x.filter(F.col("status").isin(*RETAINED) & F.col("cell").isNotNull())
    left = into.select(F.explode("evicted").alias("id"), F.col("window").alias("left")).groupBy("id").agg(F.min("left").alias("left"))
    end = x.agg(F.max("window").alias("end"))
    stay = into.select("id", "cell", F.col("window").alias("first")).join(left, "id", "left").crossJoin(F.broadcast(end))  # one row
    return stay.select("id", "cell", "first", F.coalesce(F.col("left") - 1, F.col("end")).alias("last")).filter("first <= last")


def residents(outcomes: DataFrame, every: int) -> DataFrame:
    """window, id, cell of the members in the archive at the end of each window, until the last window with an outcome."""
    return stays(outcomes, every).select(F.explode(F.sequence("first", "last")).alias("window"), "id", "cell")


def _changes(held: DataFrame, *keys: str) -> DataFrame:
    """keys, window, n: how many of ``held`` (keys, first, last, n) come at the start of each window less those gone since the one before."""
    both = F.explode(F.array(F.struct(F.col("first").alias("window"), "n"), F.struct((F.col("last") + 1).alias("window"), (-F.col("n")).alias("n"))))
    return held.select(*keys, both.alias("c")).groupBy(*keys, "c.window").agg(F.sum("c.n").alias("n"))


def _running(changes: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """keys, window, n: how many are there in each (keys, window) of ``asked``."""
    both = changes.select(*keys, "window", "n", F.lit(False).alias("asked")).unionByName(asked.select(*keys, "window", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    so_far = Window.partitionBy(*keys).orderBy("window").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("n", F.sum("n").over(so_far)).filter("asked").drop("asked")


def _coded(values: DataFrame) -> DataFrame:
    """name, value, code: the place of each distinct value (name, value) of a name in order, from 0; ranges of values are numbered on their own."""
    splits = values.groupBy("name").agg(F.percentile_approx("value", F.array(*[F.lit(i / _RANGES) for i in range(1, _RANGES)]), F.lit(1000)).alias("splits"))
    dealt = values.join(splits, "name").withColumn("part", F.size(F.filter("splits", lambda s: s < F.col("value")))).drop("splits")
    below = F.sum("n").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n")).select("name", "part", F.coalesce(below, F.lit(0)).alias("below"))
    place = F.row_number().over(Window.partitionBy("name", "part").orderBy("value")) - 1
    return dealt.withColumn("place", place).join(parts, ["name", "part"]).select("name", "value", (F.col("place") + F.col("below")).alias("code"))


def _means(held: DataFrame, windows: DataFrame) -> DataFrame:
    """name, window, mean of windows (name, window, n). A stay is cut into aligned blocks of 1, 2, 4, ... windows, so a window adds a sum for each
    size of block and nothing is ever subtracted."""
    last = held.agg(F.max("last")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit((last + 1).bit_length()))
    low, high = F.expr("(first + pow2 - 1) DIV pow2"), F.expr("(last + 1) DIV pow2")
    x = held.groupBy("name", "first", "last").agg(F.sum(F.col("value") * F.col("n")).alias("sum"))
    x = x.withColumn("level", F.explode(levels)).withColumn("pow2", F.expr("shiftleft(1L, level)"))
    x = x.withColumns({"low": low, "high": high}).filter("low < high")
    ends = F.array_compact(F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1)))
    blocks = x.select("name", "level", F.explode(ends).alias("block"), "sum").groupBy("name", "level", "block").agg(F.sum("sum").alias("sum"))
    asked = windows.withColumn("level", F.explode(levels)).withColumn("block", F.expr("shiftright(window, level)"))
    return asked.join(blocks, ["name", "level", "block"]).groupBy("name", "window", "n").agg((F.sum("sum") / F.col("n")).alias("mean"))


def resident_distributions(held: DataFrame, prefix: str) -> DataFrame:
    """``distributions`` of the values there in each window, from stays (name, value, first, last), without a row for each stay and window.

    The values' places in order are read digit by digit: how many of the values under a digit are there in a window is a running sum of
    comings and goings, asked only for the ranks that the statistics need. A round asks one digit of all windows and names.
    """
    held = cut(held.filter("value IS NOT NULL").groupBy("name", "value", "first", "last").agg(F.count(F.lit(1)).alias("n")), "held")
    span = held.groupBy("name").agg(F.min("first").alias("a"), F.max("last").alias("b")).select("name", F.explode(F.sequence("a", "b")).alias("window"))
    windows = cut(_running(_changes(held, "name"), span, "name").filter("n > 0"), "windows")
    codes = cut(_coded(held.select("name", "value").distinct()), "codes")
    changes = cut(_changes(held.join(codes, ["name", "value"]), "name", "code"), "changes")
    most = codes.agg(F.max("code")).first()[0] or 0
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    ranks = [F.lit(0), *[f(at(q)) for q in QUARTERS for f in (F.floor, F.ceil)], F.col("n") - 1]
    asked = windows.select("name", "window", F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("k", "rest")).withColumn("node", F.lit(0).cast("long"))
    for level in reversed(range(max(1, -(-most.bit_length() // _DIGIT)))):
        here = changes.groupBy("name", F.shiftright("code", _DIGIT * (level + 1)).alias("node"), F.shiftright("code", _DIGIT * level).bitwiseAND((1 << _DIGIT) - 1).alias("digit"), "window").agg(F.sum("n").alias("n"))
        each = asked.select("name", "node", "window").distinct().withColumn("digit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << _DIGIT) - 1).cast("long"))))
        per = _running(here, each, "name", "node", "digit").groupBy("name", "node", "window").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("per"))
        none = F.struct(F.col("rest"), F.lit(-1).cast("long").alias("digit"))
        step = lambda s, e: F.when(s["digit"] >= 0, s).when(e["n"] > s["rest"], F.struct(s["rest"].alias("rest"), e["digit"].alias("digit"))).otherwise(F.struct((s["rest"] - e["n"]).alias("rest"), s["digit"].alias("digit")))
        found = asked.join(per, ["name", "node", "window"]).withColumn("s", F.aggregate("per", none, step))
        asked = cut(found.select("name", "window", "k", F.col("s.rest").alias("rest"), (F.col("node") * (1 << _DIGIT) + F.col("s.digit")).alias("node")), "asked")
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}")
    v = asked.withColumnRenamed("node", "code").join(codes, ["name", "code"]).groupBy("name", "window").agg(*[value(k) for k in range(len(ranks))])
    v = v.join(_means(held, windows), ["name", "window"])
    low, high = (lambda k: F.col(f"v{2 * k + 1}")), (lambda k: F.col(f"v{2 * k + 2}"))
    quarter = lambda k, q: F.when(low(k) == high(k), low(k)).otherwise(low(k) + (high(k) - low(k)) * (at(q) - F.floor(at(q))))
    first, second, third = (quarter(k, q) for k, q in enumerate(QUARTERS))
    return _six(v.select("window", "name", F.col("v0").alias("minimum"), first.alias("first_quartile"), second.alias("median"), "mean", third.alias("third_quartile"), F.col(f"v{len(ranks) - 1}").alias("maximum")), prefix)


def archive_distributions(outcomes: DataFrame, descriptors: DataFrame, every: int) -> DataFrame:
    """Distribution of the members' descriptors (id, name, value) and of the members per cell at the end of each window."""
    here = cut(stays(outcomes, every), "stays")
    values = resident_distributions(here.join(descriptors, "id").select("name", "value", "first", "last"), "archive_descriptor")
    per = _changes(here.withColumn("n", F.lit(1).cast("long")), "cell")
    span = here.groupBy("cell").agg(F.min("first").alias("a"), F.max("last").alias("b")).select("cell", F.explode(F.sequence("a", "b")).alias("window"))
    sizes = _running(per, span, "cell").filter("n > 0").select("window", F.lit("members").alias("name"), F.col("n").cast("double").alias("value"))
    return values.unionByName(distributions(sizes, "archive_cell"))


def cell_diagnostics(outcomes: DataFrame, every: int) -> DataFrame:
    """window, cell, attempts, accepted, acceptance_ratio, evictions, stagnation of every cell visited so far at the end of each window.

    Counts per cell and window come first; a cell then has one row a window. Stagnation is counted from the last accepted step, 0 if none.
    """
    kept = F.col("status").isin(*RETAINED)
    x = outcomes.withColumn("window", cadence(F.col("step"), every))
    ends = x.groupBy("window").agg(F.max("step").alias("end"))
    c = x.filter("cell IS NOT NULL").groupBy("cell", "window").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("k"), F.sum(F.when(kept, F.size("evicted")).otherwise(0)).alias("e"), F.max(F.when(kept, F.col("step"))).alias("s")
    )
    last = ends.agg(F.max("window").alias("last"))
    span = c.groupBy("cell").agg(F.min("window").alias("first")).crossJoin(F.broadcast(last))  # one row
    span = span.select("cell", F.explode(F.sequence("first", "last")).alias("window")).join(ends, "window")
    so_far = Window.partitionBy("cell").orderBy("window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda v: F.sum(F.coalesce(v, F.lit(0))).over(so_far)
    out = span.join(c, ["cell", "window"], "left").select("window", "cell", "end", run("n").alias("attempts"), run("k").alias("accepted"), run("e").alias("evictions"), F.max("s").over(so_far).alias("s"))
    return out.select("window", "cell", "attempts", "accepted", (F.col("accepted") / F.col("attempts")).alias("acceptance_ratio"), "evictions", (F.col("end") - F.coalesce("s", F.lit(0))).alias("stagnation"))


def archive_diagnostics(outcomes: DataFrame, every: int) -> DataFrame:
    """The cells' diagnostics as distributions, the number of cells visited and the attempts so far that no cell took."""
    d = cell_diagnostics(outcomes, every)
    names = {"attempts": "cell_attempts", "acceptance_ratio": "cell_acceptance_ratio", "stagnation": "cell_stagnation_evaluations"}
    values = d.select("window", *[F.col(k).cast("double").alias(v) for k, v in names.items()]).unpivot("window", list(names.values()), "name", "value")
    x = outcomes.withColumn("window", cadence(F.col("step"), every)).groupBy("window").agg(F.count_if(F.col("cell").isNull()).alias("lost"))
    lost = x.withColumn("lost", F.sum("lost").over(Window.orderBy("window")))  # one row a window
    visited = d.groupBy("window").agg(F.count(F.lit(1)).alias("cells"))
    counts = lost.join(visited, "window", "left")
    return distributions(values, "qd").unionByName(_long(counts, {"qd.visited_cells": F.coalesce("cells", F.lit(0)), "qd.unmapped_attempts": F.col("lost")}))
