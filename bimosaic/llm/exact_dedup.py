"""Exact deduplication with keyed streaming state.

A slim log (row number, doc_id, SHA-256 of the text, bytes, locator) is written once and then read as a stream.
The stream keeps one state row per digest, without expiry, in RocksDB: the stable identifier that stays, its row number,
its content locator (the file that holds it), and the number of rows seen. A later run may go on from the same checkpoint
(``dedup_stream``). What each batch changes in the state is written beside it, so the groups are read without opening the
stores again; every store that an executor opens costs it some memory that it does not get back, so there are as many
as the rows and the cores need. Only hits, the digests of more than one row, are confirmed on their whole bytes: a filter of fixed size keeps
all other texts out of the shuffle, and the least and the greatest text of a digest are equal exactly if all are; both aggregate
on the map side, so a group that holds a third of all rows shuffles a few rows.

Defined cases: a null text counts as empty; all empty texts form one group. Of equal texts the row with the largest doc_id
stays (null ids come last; among rows equal in id too, the one logged last), so repeated rows leave one. An empty table
gives an empty result. Columns other than ``doc_id`` and ``text`` are passed through untouched by ``drop_copies``,
even if they are named like the columns of ``exact_groups``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_bits, materialize, maybe_among, scratch, text_or_empty, with_maybe

#: Settings of the state store while the stream runs; the session's own values come back afterwards.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # for all stores of an executor together
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "1",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a stream that has ended are unloaded soon
    "spark.sql.streaming.stateStore.rocksdb.maxOpenFiles": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Rows for each part of the state, unless the cores need more parts; never more parts than the session's shuffles have.
STORE_ROWS = 50_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_log(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """row_no, doc_id, digest, n_bytes, locator: all that the state needs of a row."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(text_or_empty()).alias("digest"),
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        F.input_file_name().alias("locator"),
    )


def stores(spark: SparkSession, rows: int) -> int:
    """Parts of the state for a log of so many rows."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // STORE_ROWS)))


def dedup_stream(spark: SparkSession, log: DataFrame, checkpoint: str, updates: str | None = None, parts: int | None = None) -> int:
    """Fold what a streaming ``log`` has now into the state at ``checkpoint``; call it again when more has arrived. Returns the number of batches.

    updates: a folder for the keys that each batch changed, with their state after it. parts: of the state, where the checkpoint is new.
    """
    keyed = log.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row_no", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )
    settings = STATE_CONF | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    batches: set[int] = set()

    def put(batch: DataFrame, k: int) -> None:
        batches.add(k)
        if updates:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={k}")
        else:
            batch.write.format("noop").mode("overwrite").save()

    if updates:  # a log without a batch has changed nothing
        spark.createDataFrame([], keyed.schema).write.parquet(f"{updates}/batch=-1")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = keyed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return len(batches)


def read_updates(spark: SparkSession, updates: str, batches: int) -> DataFrame:
    """What ``read_state`` gives, from the updates of all batches since the state was empty: the last one of each digest."""
    found = spark.read.schema("digest string, keeper struct<doc_id: long, row_no: long, locator: string>, group_size long, batch long").parquet(updates)
    if batches > 1:
        found = found.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("s")).select("digest", "s.*")
    return found.select("digest", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.row_no").alias("keep_row"), "keeper.locator", "group_size")


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keep_id, keep_row, locator, group_size from the keyed state on disk."""
    state = spark.read.format("statestore").load(checkpoint)
    keeper, size = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"{keeper}.doc_id").alias("keep_id"),
        F.col(f"{keeper}.row_no").alias("keep_row"),
        F.col(f"{keeper}.locator").alias("locator"),
        F.col(size).alias("group_size"),
    )


def unequal_digests(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests among ``hits`` whose rows differ in their bytes."""
    rows = docs.select(digest(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    found = maybe_among(rows, hits.select("digest"), "digest", filter_bits(hits.count())).groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return found.filter(F.col("a") != F.col("b")).select("digest")


def exact_groups(docs: DataFrame, max_bytes_per_trigger: int = 64 << 30, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (the digest), row_no, locator (file of the row that stays)."""
    spark = docs.sparkSession
    path, checkpoint, updates = (scratch(spark, x) for x in ("digest-log", "dedup-state", "dedup-updates"))
    digest_log(docs, digest).write.parquet(path)
    log = spark.read.schema("row_no long, doc_id long, digest string, n_bytes long, locator string").parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(path)
    rows = log.count()
    batches = dedup_stream(spark, stream, checkpoint, updates, stores(spark, rows))
    state = read_updates(spark, updates, batches)
    if batches > 1:
        state = materialize(state, "dedup-groups")
    out = _decide(log, state, rows)
    bad = materialize(unequal_digests(docs, state.filter("group_size > 1"), digest), "dedup-unequal")
    if not bad.isEmpty():
        exact = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_or_empty()).alias("digest"), text_or_empty().alias("text"), F.input_file_name().alias("locator"))
        exact = exact.join(bad, "digest", "left_semi").withColumn("row_no", F.monotonically_increasing_id())
        exact = materialize(exact, "dedup-rehash")
        top = exact.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "row_no", "locator")).alias("k"), F.count(F.lit(1)).alias("group_size"))
        again = exact.drop("locator").join(top, ["digest", "text"]).select(
            "doc_id", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("k.row_no")).alias("kept"),
            F.col("digest").alias("text_sha256"), "row_no", F.col("k.locator").alias("locator"),
        )
        out = out.join(bad.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti").select(again.columns).unionByName(again)
    return out


def _decide(log: DataFrame, state: DataFrame, rows: int) -> DataFrame:
    """Rows with their group. Groups above a thousandth of all rows are a thousand at most: those are broadcast, the others join by digest."""
    limit = max(1000, rows // 1000)
    hot = state.filter(F.col("group_size") > limit)
    rest = state.filter(F.col("group_size") <= limit)
    columns = (
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"), "row_no", "locator",
    )
    log = log.drop("locator")
    cool = log.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return log.join(F.broadcast(hot), "digest").select(*columns).unionByName(cool.join(rest, "digest").select(*columns))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat a text; all columns stay as they are."""
    groups = materialize(exact_groups(docs).select("doc_id", "text_sha256", "group_size", "kept"), "dedup-decided")
    several = groups.filter("group_size > 1 AND kept").select("text_sha256")
    bits = filter_bits(several.count())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # the caller's columns, whatever their names
    marked = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("text_sha256"))
    marked = with_maybe(marked, several, "text_sha256", "hit", bits)  # other texts stay as they are and are not shuffled
    keep = maybe_among(groups.filter("kept").select("doc_id", "text_sha256"), several, "text_sha256", bits)
    keep = materialize(keep.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")), "dedup-kept")
    out = marked.filter("hit").join(keep, marked["doc_id"].eqNullSafe(keep["id"]) & (marked["text_sha256"] == keep["digest"]), "left_semi")
    rows = keep.groupBy("id", "digest").count()
    logged = groups.filter("group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not logged.join(rows, logged["doc_id"].eqNullSafe(rows["id"]) & (logged["text_sha256"] == rows["digest"]), "left_semi").isEmpty():
        out = out.dropDuplicates(["doc_id", "text_sha256"])
    return marked.filter("NOT hit").select("row.*").unionByName(out.select("row.*"))
