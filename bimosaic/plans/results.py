"""Queries over persisted results: pages, details, referential checks, configuration differences, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prepare import required_support
from ..session import cut

PATTERNS = ("constant", "additive", "multiplicative")


def page(results: DataFrame, text: str = "", feasible: bool | None = None, min_rows: int = 0, max_rows: int = 1 << 60, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of results (id, name, n_rows, feasible), filtered and ordered by id; the filters reach the scan."""
    out = results.filter(F.col("n_rows").between(min_rows, max_rows))
    if text:
        out = out.filter(F.lower("name").contains(text.lower()))
    if feasible is not None:
        out = out.filter(F.col("feasible") == feasible)
    return out.orderBy("id").offset(offset).limit(limit)


def with_pattern(results: DataFrame, patterns: DataFrame, pattern: str) -> DataFrame:
    return results.join(patterns.filter(F.col("pattern") == pattern).select("id"), "id", "left_semi")


def orphans(details: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Detail rows without a result; a sound store has none."""
    return details.join(results.select(key), key, "left_anti")


def varying(configurations: DataFrame) -> DataFrame:
    """path, pipeline, value of the settings (pipeline, path, value) that differ between pipelines."""
    differ = configurations.groupBy("path").agg(F.count_distinct("value").alias("n")).filter("n > 1")
    return configurations.join(differ.select("path"), "path", "left_semi")


def export_json(df: DataFrame, columns: list[str], name: str = "json") -> DataFrame:
    """List and struct columns as JSON text, for CSV sinks."""
    return df.withColumn(name, F.to_json(F.struct(*columns)))


def cached_cases(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases that still have to run: their fingerprint is not among those done."""
    return cases.join(done.select("fingerprint"), "fingerprint", "left_anti")


def in_scope(truths: DataFrame, patterns: DataFrame, allowed: list[str]) -> DataFrame:
    """Ground-truth biclusters (id) whose patterns (id, pattern) are all allowed; one without patterns is in scope."""
    return truths.join(patterns.filter(~F.col("pattern").isin(*allowed)).select("id"), "id", "left_anti")


def source_columns(members: DataFrame, columns: DataFrame) -> DataFrame:
    """id, column_index of the source table, each once, from prepared members (id, column_index) and columns (column_index, source_column_index)."""
    return members.join(columns, "column_index").select("id", F.col("source_column_index").alias("column_index")).distinct()


def subsample(rows: DataFrame, picked: DataFrame, *aligned: DataFrame) -> tuple[DataFrame, ...]:
    """The picked rows (row_index, repeats count once) of a table and of the tables aligned with it."""
    return tuple(df.join(picked.select("row_index"), "row_index", "left_semi") for df in (rows, *aligned))


def spread_sample(results: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` results at equal steps of their order by ``key``, the first and the last among them; all of them if there are no more.

    Sorted by range first, then counted per range, so that no task holds the whole order; ``key`` must be unique.
    """
    ranged = cut(results.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "spread")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__from"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__from")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))  # one row a range
    ranked = ranged.join(F.broadcast(before), "__part").withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("__before"))
    if count < 2:
        return ranked.filter(F.col("__at") < count).drop("__part", "__before", "__all", "__at")
    step = (F.col("__all") - 1) / F.lit(float(count - 1))
    near = F.floor(F.col("__at") / step)
    hit = F.exists(F.array(near, near + 1), lambda k: (k < count) & (F.floor(k * step) == F.col("__at")))  # a place's step, and one for rounding
    picked = (F.col("__all") <= count) | hit
    return ranked.filter(picked).drop("__part", "__before", "__all", "__at")


def composition(columns: DataFrame) -> DataFrame:
    """candidate, columns, columns of each pattern, number of patterns and share of derived indicators; columns (candidate, column_index, pattern, derivation)."""
    derived = F.count_if(F.col("derivation") == "missingness_indicators")
    return columns.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("columns"), *[F.count_if(F.col("pattern") == p).alias(f"{p}_columns") for p in PATTERNS],
        F.count_distinct("pattern").alias("patterns"), derived.alias("indicators"), (derived / F.count(F.lit(1))).alias("indicator_share"),
    )


def coverage_gaps(results: DataFrame, algorithm: str, dataset: str) -> DataFrame:
    """Datasets that not every algorithm covers, with the number of those that do and of all; a fair comparison has none."""
    pairs = results.select(algorithm, dataset).distinct()
    whole = pairs.agg(F.count_distinct(algorithm).alias("algorithms"))
    per = pairs.groupBy(dataset).agg(F.count(F.lit(1)).alias("covered")).crossJoin(F.broadcast(whole))  # one row
    return per.filter("covered < algorithms")


def select_each(results: DataFrame, selectors: dict[str, tuple[Column, list[Column], int]]) -> DataFrame:
    """selector, rank and the results that each of several selectors takes from one stored search: (condition, order, count) by name.

    A selector is a top-k of its own, so partitions keep ``count`` rows each and nothing is sorted as a whole.
    """
    out = None
    for name, (condition, order, count) in selectors.items():
        top = results.filter(condition).orderBy(*order).limit(count)
        top = top.select(F.lit(name).alias("selector"), F.row_number().over(Window.orderBy(*order)).alias("rank"), *results.columns)
        out = top if out is None else out.unionByName(top)
    return out


def summaries(results: DataFrame, values: DataFrame, patterns: DataFrame) -> DataFrame:
    """Results with their named values (id, kind, name, value) as one map a kind, and their distinct patterns (id, pattern) in order.

    A result has as many values as the search has objectives, constraints and descriptors, and at most a pattern a column.
    """
    out = results
    for kind in ("objective", "constraint", "descriptor"):
        named = values.filter(F.col("kind") == kind).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias(f"{kind}s"))
        out = out.join(named, "id", "left")
    return out.join(patterns.groupBy("id").agg(F.array_sort(F.collect_set("pattern")).alias("patterns")), "id", "left")


def canonical(repertoire: DataFrame) -> DataFrame:
    """Members in order of cell, then signature: a range sort over all partitions."""
    return repertoire.orderBy("cell", "signature")


def replicate(datasets: DataFrame, name: str = "dataset") -> DataFrame:
    """``family`` and ``replicate``: the name without and the number after a last underscore; no replicate where there is none."""
    number = F.regexp_extract(name, r"_(\d+)$", 1)
    return datasets.withColumn("family", F.regexp_replace(name, r"_\d+$", "")).withColumn("replicate", F.nullif(number, F.lit("")).cast("long"))


def feasible_shapes(wanted: DataFrame, supports: DataFrame, ratio: float = 0.8) -> DataFrame:
    """shape, n_rows, n_columns: the shape nearest to each wanted one whose columns are all observed often enough, none if there is no such.

    wanted: shape, rows, min_rows, max_rows, columns, min_columns, max_columns; supports: column_index, support. Fewer rows need less
    support, so the largest number of rows up to the wanted one at which ``min_columns`` columns suffice is the nearest. Shapes meet the
    distinct supports only, of which a table of n cells has some sqrt(2 n) at most, and each distinct question is asked once.
    """
    counts = supports.filter("support IS NOT NULL").groupBy("support").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("support"))))  # columns with this support or more
    x = wanted.filter("min_rows <= max_rows AND min_columns <= max_columns").withColumn("bounded", F.least(F.greatest("rows", "min_rows"), "max_rows"))
    least = x.select("min_columns").distinct().join(counts, F.col("upto") >= F.col("min_columns")).groupBy("min_columns").agg(F.max("support").alias("least"))
    x = x.join(least, "min_columns").filter("least >= 2").withColumn("n_rows", F.least("bounded", F.floor(F.col("least") / ratio + 1e-9))).filter("n_rows >= min_rows")
    x = x.withColumn("required", required_support(F.col("n_rows"), ratio=ratio))
    capacity = x.select("required").distinct().join(counts, F.col("support") >= F.col("required")).groupBy("required").agg(F.max("upto").alias("capacity"))
    x = x.join(capacity, "required")
    n = F.least(F.greatest("columns", "min_columns"), F.least("max_columns", "capacity"))
    return x.select("shape", F.col("n_rows").cast("long").alias("n_rows"), n.cast("long").alias("n_columns"))
