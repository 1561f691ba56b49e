"""Final selection: representatives, utilities, quality floor and evidence cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# The quality floor's bounds, the candidates and the prominence that a knee needs, the fallback quantile, and the cover's penalties.
MINIMUM_FLOOR, MAXIMUM_FLOOR, KNEE_CANDIDATES, KNEE_PROMINENCE, FALLBACK_QUANTILE = 0.5, 0.85, 8, 0.05, 0.5
REDUNDANCY, LOW_QUALITY, COMPLEXITY, MINIMUM_GAIN = 0.5, 0.5, 0.25, 1.0
#: Ranges of quality whose counts give the first part of a rank.
RANGES = 1000


def representatives(candidates: DataFrame) -> DataFrame:
    """One row for each signature: least coherence, most contrast, earliest generation, lowest id; all sources are kept.

    Columns: id, signature, coherence, contrast, generation.
    """
    order = Window.partitionBy("signature").orderBy("coherence", F.desc("contrast"), "generation", "id")
    sources = candidates.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("sources"))
    best = candidates.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
    return best.join(sources, "signature")


def utilities(candidates: DataFrame, minimise: list[str], maximise: list[str]) -> DataFrame:
    """``utility``: mean of the objectives scaled to 0 (worst) .. 1 (best) over all candidates; a constant objective gives 1."""
    bounds = candidates.agg(*[f(c).alias(f"__{n}_{c}") for c in minimise + maximise for n, f in (("lo", F.min), ("hi", F.max))])
    out = candidates.crossJoin(F.broadcast(bounds))  # one row
    parts = []
    for c in minimise + maximise:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        scaled = (hi - F.col(c) if c in minimise else F.col(c) - lo) / F.when(hi > lo, hi - lo)
        parts.append(F.coalesce(scaled, F.lit(1.0)))
    return out.withColumn("utility", sum(parts, F.lit(0.0)) / len(parts)).drop(*bounds.columns)


def quality_knee(candidates: DataFrame, quality: str = "quality", minimum: float = MINIMUM_FLOOR, maximum: float = MAXIMUM_FLOOR, enough: int = KNEE_CANDIDATES, prominence: float = KNEE_PROMINENCE, fallback: float = FALLBACK_QUANTILE) -> DataFrame:
    """One row (floor, source, n, span, prominence): the adaptive quality floor.

    Qualities in falling order, scaled to 1 .. 0, are held against the chord. The upper knee rises most above it, the lower one
    falls most below it, ends excluded; where the upper comes first and both stand out by ``prominence``, the floor is half way
    between their qualities, else the quantile ``fallback``; with fewer than ``enough`` candidates, ``minimum``. Always within
    ``minimum`` and ``maximum``. Equal qualities are counted first, and ranks come from counts per range of quality, so no task
    holds all candidates.
    """
    one = candidates.select(F.col(quality).cast("double").alias("q")).filter("q IS NOT NULL")
    by_value = one.groupBy("q").agg(F.count(F.lit(1)).alias("c"))
    bounds = by_value.agg(F.sum("c").alias("n"), F.max("q").alias("hi"), F.min("q").alias("lo"), F.expr(f"percentile(q, {fallback}, c)").alias("quantile"))
    bounds = cut(bounds.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("span", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0))), "knee-bounds")
    at = by_value.crossJoin(F.broadcast(bounds)).filter("span > 1e-12 AND n > 2")  # one row
    at = cut(at.withColumn("range", F.least(F.floor((F.col("hi") - F.col("q")) / F.col("span") * RANGES), F.lit(RANGES - 1))), "knee-values")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = at.groupBy("range").agg(F.sum("c").alias("r"))
    ranges = ranges.select("range", F.coalesce(F.sum("r").over(upto(Window.partitionBy(F.lit(0)).orderBy("range"))), F.lit(0)).alias("before"))
    at = at.join(F.broadcast(ranges), "range")  # RANGES rows at most
    at = at.withColumn("first", F.col("before") + F.coalesce(F.sum("c").over(upto(Window.partitionBy("range").orderBy(F.desc("q")))), F.lit(0)))
    at = at.withColumn("last", F.least(F.col("first") + F.col("c") - 1, F.col("n") - 2)).withColumn("first", F.greatest("first", F.lit(1))).filter("first <= last")
    above = lambda rank: (F.col("q") - F.col("lo")) / F.col("span") - 1 + F.col(rank) / (F.col("n") - 1)
    knees = at.agg(
        F.max(F.struct(above("last").alias("p"), (-F.col("last")).alias("at"), "q")).alias("up"),
        F.max(F.struct((-above("first")).alias("p"), (-F.col("first")).alias("at"), "q")).alias("down"),
    )
    out = bounds.crossJoin(F.broadcast(knees))
    least = F.coalesce(F.greatest(F.least("up.p", "down.p"), F.lit(0.0)), F.lit(0.0))
    is_knee = F.coalesce((F.col("up.at") > F.col("down.at")) & (least + 1e-12 >= prominence), F.lit(False))
    source = F.when(F.col("n") < enough, "minimum").when(is_knee, "knee").otherwise("quantile")
    floor = F.when(F.col("n") < enough, F.lit(minimum)).otherwise(F.greatest(F.lit(minimum), F.least(F.lit(maximum), F.when(is_knee, (F.col("up.q") + F.col("down.q")) / 2).otherwise(F.col("quantile")))))
    return out.select(floor.alias("floor"), source.alias("source"), "n", "span", F.when(source == "knee", least).otherwise(0.0).alias("prominence"))


def strength(quality: Column, floor: float) -> Column:
    return F.greatest(quality - floor, F.lit(0.0)) / (1 - floor)


def log2_choose(n: Column, k: Column, table: DataFrame | None = None) -> Column:
    """log2 of the binomial coefficient by the sum of logarithms; for the small k of a bicluster's side."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log2((n - k + i).cast("double")) - F.log2(i.cast("double")))


def description_length(all_rows: int, all_columns: int) -> Column:
    return log2_choose(F.lit(all_rows).cast("long"), F.col("n_rows")) + log2_choose(F.lit(all_columns).cast("long"), F.col("n_columns"))


def low_quality(quality: Column, floor: float) -> Column:
    """Shortfall below the floor, as a share of it."""
    return F.greatest(floor - quality, F.lit(0.0)) / floor if floor > 1e-12 else F.lit(0.0)


def first_round_gain(candidates: DataFrame, all_rows: int, all_columns: int, floor: float = MINIMUM_FLOOR, complexity: float = COMPLEXITY, penalty: float = LOW_QUALITY) -> DataFrame:
    """``net`` of every candidate (quality, n_rows, n_columns) against an empty cover: evidence less its low-quality cost and its description length."""
    size = F.col("n_rows") * F.col("n_columns")
    gain = (strength(F.col("quality"), floor) - penalty * low_quality(F.col("quality"), floor)) * size
    return candidates.withColumn("net", gain - complexity * description_length(all_rows, all_columns))


def evidence_cover(
    candidates: DataFrame, rows: DataFrame, columns: DataFrame, all_rows: int, all_columns: int, floor: float = MINIMUM_FLOOR,
    redundancy: float = REDUNDANCY, penalty: float = LOW_QUALITY, complexity: float = COMPLEXITY, minimum: float = MINIMUM_GAIN,
) -> DataFrame:
    """Greedy cover of the evidence in a matrix: rank, id, net, new, redundant, in order of choice, until no candidate gains more than ``minimum``.

    A cell of a candidate (id, quality; its rows and columns) holds the candidate's strength above the floor. What exceeds the
    cover so far is new, the rest redundant; low quality and the bits that name the candidate's rows and columns are costs. A
    gain never rises as the cover grows, so only candidates above ``minimum`` in the first round take part, and none returns
    that once fell to it. Each round is one aggregate over cells, written with the grown cover to the folder all executors share;
    only the winner comes to the driver. Equal gains go to the higher quality, then the larger candidate, then the lower id.
    """
    size = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).join(columns.groupBy("id").agg(F.count(F.lit(1)).alias("n_columns")), "id")
    own = first_round_gain(candidates.select("id", "quality").join(size, "id"), all_rows, all_columns, floor, complexity, penalty).filter(F.col("net") > minimum)
    cells = F.col("n_rows") * F.col("n_columns")
    own = own.select("id", "quality", cells.alias("cells"), strength(F.col("quality"), floor).alias("s"), (penalty * low_quality(F.col("quality"), floor) * cells + complexity * description_length(all_rows, all_columns)).alias("cost"))
    own = cut(own, "cover-candidates")
    all_cells = cut(rows.join(columns, "id").join(own.select("id", "s"), "id").select("id", "row_index", "column_index", "s"), "cover-cells")
    cover = cut(all_cells.select("row_index", "column_index", F.col("s").alias("c")).limit(0), "cover")
    chosen: list[tuple] = []
    while True:
        x = all_cells.join(cover, ["row_index", "column_index"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
        gain = x.groupBy("id").agg(F.sum(F.greatest(F.col("s") - F.col("c"), F.lit(0.0))).alias("new"), F.sum(F.least("s", "c")).alias("redundant"))
        net = gain.join(own, "id").withColumn("net", F.col("new") - redundancy * F.col("redundant") - F.col("cost")).filter(F.col("net") > minimum + 1e-12)
        net = cut(net, "cover-gains")
        top = net.orderBy(F.desc("net"), F.desc("quality"), F.desc("cells"), "id").first()
        if top is None:
            schema = "rank int, id long, net double, new double, redundant double"
            return candidates.sparkSession.createDataFrame(chosen, schema)
        chosen.append((len(chosen), top["id"], top["net"], top["new"], top["redundant"]))
        won = all_cells.filter(F.col("id") == top["id"]).select("row_index", "column_index", F.col("s").alias("c"))
        cover = cut(cover.unionByName(won).groupBy("row_index", "column_index").agg(F.max("c").alias("c")), "cover")
        own = own.join(net.select("id").filter(F.col("id") != top["id"]), "id", "left_semi")
