"""Helpers shared by the corpus operators: scratch tables, words, row sampling by hash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, newline, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the filter that keeps rows without a partner out of a shuffle: 8 MB at most, whatever the number of partners.
FILTER_BITS = 1 << 26
#: Bits for each partner where they are few: executors hold a broadcast long after its join.
KEY_BITS = 256

CODEC = "spark.sql.parquet.compression.codec"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that Spark's reader of Parquet decodes at once; its own 4096 are tens of MB where rows hold whole texts, for each task.
READ = {"spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Rows for each task that writes a table of known size, unless the cores need more tasks.
TASK_ROWS = 50_000

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder all executors share.

    Only where the setting is missing (tests on one machine) a temporary folder of this machine serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("base", tempfile.mkdtemp(prefix="spark-scratch-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a slim table of so many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def materialize(df: DataFrame, name: str, batch: int = 500, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    Meanwhile batches have few rows, those for Arrow ``batch`` at most, as rows hold whole texts or more; the session's own settings come back afterwards.
    Tables without text (numbers, hashes, digests) hardly shrink and are not compressed, which spares the codec's buffers for each column of each task.
    rows: about how many there are at most, where that is known; then a slim table is not written in as many files as shuffles have parts.
    """
    spark = df.sparkSession
    path, settings = scratch(spark, name), READ | {BATCH: str(batch)}
    if "string" not in df.schema.simpleString():
        settings[CODEC] = "uncompressed"
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        (df if rows is None else df.coalesce(tasks_for(spark, rows))).write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the identifier written as text; splits rows into folds that any engine can reproduce."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sample_by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``keys``: the same rows on every run, spread over the whole table."""
    return df.orderBy(F.xxhash64(*keys, F.lit(17)), *keys).limit(n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds for a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def filter_bits(keys: int) -> int:
    """Bits of a filter for at most so many keys: a power of two, from one part of 4 KB to ``FILTER_BITS``."""
    return min(FILTER_BITS, max(1 << 15, 1 << (KEY_BITS * keys - 1).bit_length()))


def maybe_among(rows: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` whose ``column`` may be among those of ``keys``."""
    return with_maybe(rows, keys, column, "__maybe", bits).filter("__maybe").drop("__maybe")


def with_maybe(rows: DataFrame, keys: DataFrame, column: str, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``flag``: whether ``column`` may be among those of ``keys``; one bit for each hash value, in parts of 4 KB, ``bits`` in all.

    The parts are broadcast, as their size has that bound. Where the filter fills up it lets more rows through, never fewer.
    """
    value = F.pmod(F.xxhash64(column), F.lit(bits)).cast("long") + 1
    parts = keys.select(value.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("__bits"))
    marked = rows.withColumn("__part", F.bitmap_bucket_number(value)).withColumn("__at", F.bitmap_bit_position(value))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))
    return marked.join(F.broadcast(parts), "__part", "left").select(*rows.columns, hit.alias(flag))
