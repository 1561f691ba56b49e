"""Sharding by extendible hashing, in DataFrame functions alone.

A row's address is a string of bits: 60 of the MD5 of its id, then 60 that tell rows of equal id apart. Bytes are summed for
every prefix of the address up to a working depth; a bucket splits on its next bit only while it is over the limit, so a
shard is the shortest prefix that fits. The directory maps addresses to shards. Where buckets are still too large at the working
depth (one id on many rows), the same is done deeper for these rows alone.

Defined cases: a null text has 0 bytes; a row larger than the limit is a shard of its own; null ids hash alike and are parted by
the second half of the address; repeated rows are rows of their own; an empty table has no shards. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

MAX_BYTES = 16 << 20
BITS = 120
SLACK = 5


def address() -> Column:
    """The bits of a row's address; needs ``row_no``."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = F.md5(F.col("row_no").cast("string"))
    return F.concat(*(F.lpad(F.conv(F.substring(x, 1, 15), 16, 2), 60, "0") for x in (digest, own)))


def _prefix(depth: int) -> Column:
    return F.substring("bits", 1, depth)


def directory(rows: DataFrame, depth: int, max_bytes: int, start: int = 0) -> DataFrame:
    """cell (prefix of ``depth`` bits), shard, shard_bytes, shard_docs; shard is null where even the cell is too large."""
    cells = materialize(rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "shard-cells")
    paths = cells.withColumn("d", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn("shard", F.expr("substring(cell, 1, d)"))
    sums = paths.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = materialize(sums.filter((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1)), "shard-fits")
    found = paths.select("cell", "shard").join(fits, "shard").groupBy("cell").agg(F.min_by(F.struct("shard", "shard_bytes", "shard_docs"), F.length("shard")).alias("s"))
    return cells.select("cell").join(found, "cell", "left").select("cell", "s.shard", "s.shard_bytes", "s.shard_docs")


def shards(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (its bits), depth, shard_bytes, shard_docs of every row."""
    slim = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    slim = materialize(slim.withColumn("bits", address()), "shard-rows")
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / max_bytes))) + SLACK)
    rows, start, out = slim, 0, None
    while True:
        cells = materialize(directory(rows, depth, max_bytes, start), "shard-directory")
        placed = rows.withColumn("cell", _prefix(depth)).join(cells, "cell")
        done = placed.filter("shard IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        if cells.filter("shard IS NULL").isEmpty():
            break
        if depth == BITS:  # rows of one address
            left = placed.filter("shard IS NULL").drop("shard", "shard_bytes", "shard_docs")
            whole = left.groupBy("cell").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
            out = out.unionByName(left.join(whole, "cell").withColumn("shard", F.col("cell")).select(*out.columns))
            break
        rows = materialize(placed.filter("shard IS NULL").select(*slim.columns), "shard-rows")
        start, depth = depth + 1, min(BITS, depth + 16)
    return out.select("doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs")
