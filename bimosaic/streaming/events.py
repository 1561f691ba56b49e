"""Run-event metrics: batch plans, and the same windows as Structured Streaming queries.

Events are ordered by an integer ``step``; a cadence window is a tumbling window over it. Nothing is dropped when consumers lag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cadence(step, every: int):
    """Number of the count-based window of a step, from 1."""
    return F.ceil((step + 1) / every).cast("long")


KINDS = ("click", "error", "purchase", "signup", "view")


def outcome_rates(events: DataFrame, every: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """window, n and the share of each of ``kinds`` within windows of ``every`` evaluations; events (step, kind)."""
    return events.groupBy(cadence(F.col("step"), every).alias("window")).agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("kind") == k).cast("double")).alias(f"{k}_rate") for k in kinds])


def rollup(events: DataFrame, stage: str, duration: str, order: str, report: str) -> DataFrame:
    """Per stage: number, total and mean duration, 95th percentile and the latest report."""
    return events.groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"), F.sum(duration).alias("total"), F.avg(duration).alias("mean"),
        F.percentile(duration, F.lit(0.95)).alias("p95"), F.max_by(report, order).alias("latest"),
    )


def emitted_on_change(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before them."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return events.filter(F.col(value).isNotNull()).withColumn("__b", before).filter(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")


def credit_delta(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``delta`` to the previous report of the same key."""
    return events.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy(key).orderBy(order)))


def running_diversity(events: DataFrame, part: str, order: str, item: str, last: int = 128) -> DataFrame:
    """cumulative_unique and cumulative_duplicates so far, and the mean of ``value`` over the last rows."""
    seen = F.row_number().over(Window.partitionBy(part, item).orderBy(order)) == 1
    so_far = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = Window.partitionBy(part).orderBy(order).rowsBetween(-(last - 1), Window.currentRow)
    out = events.withColumn("__new", seen.cast("long"))
    return out.withColumn("cumulative_unique", F.sum("__new").over(so_far)).withColumn("cumulative_duplicates", F.count(F.lit(1)).over(so_far) - F.col("cumulative_unique")).withColumn("recent_mean", F.avg("value").over(recent)).drop("__new")


def keyset_page(events: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    return events.filter(F.col(key) > after).orderBy(key).limit(limit)


def latest_ascending(events: DataFrame, key: str, limit: int) -> DataFrame:
    return events.orderBy(F.desc(key)).limit(limit).orderBy(key)


def stream_outcome_rates(spark: SparkSession, path: str, schema, every: int, checkpoint: str, table: str):
    """The streaming form of ``outcome_rates``: a keyed aggregate in update mode over a file source; the caller stops the query."""
    events = spark.readStream.schema(schema).parquet(path).select((F.col("event_id")).alias("step"), F.col("event_type").alias("kind"))
    return outcome_rates(events, every).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_windows(spark: SparkSession, path: str, schema, width: str, late: str):
    """Event-time tumbling windows with a watermark."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
