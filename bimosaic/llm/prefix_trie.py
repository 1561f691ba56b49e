"""Prefix trie of conversations by union-find over sorted-neighbour LCP edges.

A turn is a 128-bit digest of role and text, a conversation the string of its turns' digests. Equal conversations are one sequence
with a count. The distinct sequences are sorted in ranges; two neighbours in this order have an edge, whose depth is the number of
turns they share at the start (LCP). In each range a union-find takes the edges in descending depth: every merge of two components
creates the branching node of that depth, or adds to it, and the turns between a component's top and that node are nodes with one
child. What is left of a range is its contracted forest: only nodes on the way to a neighbouring range (prefixes of the range's
first or last sequence that the next range shares) are incomplete. They are merged across the boundaries by the digest of their
prefix; each belongs to the first range that has it. A node's subtree is a run of ranges, so what the merged nodes add to it is a
difference of prefix sums over the ranges. The driver sees one number or two for each range.

The hash of the conversations that end in a node is fed in order: ids are joined in stretches of ``STRETCH`` first, so a sequence
that a third of all conversations have reaches its task as few rows, which it reads one after the other.

Defined cases: a null conv_id names no conversation and is left out; null role or text is empty; null turns come first, equal turns
are ordered by their digest; repeated rows are turns of their own; negative ids take the remainder of SQL; an empty table gives no
nodes, not even a root. Other columns are not read. A conversation is one row, however many turns it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Hex digits of a turn's digest.
WIDTH = 32
#: Turns in a range, about.
RANGE = 25_000
#: Neighbouring ids that are joined before hashing: 2 to this power.
STRETCH = 9
FAMILY, HEADS = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOREST = (
    "part int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, ends string,"
    " key string, parent_key string, shared boolean"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, t: the turns of each conversation in order, as structs of turn, digest and words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDTH)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def with_family_heads(rows: DataFrame) -> DataFrame:
    """conv_id, t: the first h turns of the family's first conversation (conv_id - conv_id % FAMILY), then the own turns after the first h."""
    rows = materialize(rows, "conversations")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    family = rows.select(F.col("conv_id").alias("family"), F.slice("t", 1, HEADS - 1).alias("head"))
    own = rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(family, "family", "left")
    head = F.when(F.col("head").isNull(), F.slice("t", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    rest = F.slice("t", h + 1, F.greatest(F.size("t") - h, F.lit(0)))
    return own.select("conv_id", F.concat(head, rest).alias("t"))


def ends_of(members: DataFrame) -> DataFrame:
    """seq, ends: SHA-256 of the ascending conv_ids of each sequence, joined by commas; members: conv_id, seq."""
    stretch = F.shiftright("conv_id", STRETCH)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = members.groupBy("seq", stretch.alias("stretch")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = state = None
        for b in batches:
            names, out = [], []
            for s, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if s != seq:
                    if seq is not None:
                        names.append(seq)
                        out.append(state.hexdigest())
                    seq, state = s, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["seq", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], ["seq", "ends"])

    return parts.repartition("seq").sortWithinPartitions("seq", "stretch").select("seq", "ids").mapInArrow(run, "seq string, ends string")


def shared_turns(a: str, b: str) -> int:
    """Turns that two sequences share at the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = (np.frombuffer(s[:n].encode(), np.uint8) for s in (a, b))
    return int((x != y).argmax()) // WIDTH


class Forest:
    """The trie of one range of sorted distinct sequences: parallel lists of nodes; node i < m is where sequence i ends."""

    def __init__(self, keys: list[str]) -> None:
        m = len(keys)
        self.depth = [len(k) // WIDTH for k in keys]
        self.parent: list[int] = [-1] * m
        self.low, self.high = list(range(m)), list(range(m))  # first and last sequence of a node
        component, top = list(range(m)), list(range(m))

        def root(x: int) -> int:
            while component[x] != x:
                component[x] = component[component[x]]
                x = component[x]
            return x

        lcp = [shared_turns(a, b) for a, b in zip(keys, keys[1:])]
        for i in sorted(range(m - 1), key=lambda i: (-lcp[i], i)):
            a, b = root(i), root(i + 1)
            node = top[a]
            if self.depth[node] > lcp[i]:
                below = self.lifted(node, lcp[i])
                node = self.new(lcp[i], self.low[below], self.high[below])
                self.parent[below] = node
            below = self.lifted(top[b], lcp[i])
            self.parent[below] = node
            self.high[node] = self.high[below]
            component[b] = a
            top[a] = node
        self.lifted(top[root(0)], -1)

    def new(self, depth: int, low: int, high: int) -> int:
        self.depth.append(depth)
        self.parent.append(-1)
        self.low.append(low)
        self.high.append(high)
        return len(self.depth) - 1

    def lifted(self, node: int, to: int) -> int:
        """The highest of a chain of new nodes with one child, from above ``node`` to below depth ``to``."""
        for depth in range(self.depth[node] - 1, to, -1):
            self.parent[node] = above = self.new(depth, self.low[node], self.high[node])
            node = above
        return node


def range_rows(part: int, table: pa.Table, left: int | None, right: int | None) -> dict[str, list]:
    """Rows of FOREST for one range; left, right: turns that its first and last sequence share with the neighbouring ranges (None: no range there)."""
    table = table.sort_by("key")
    keys, conv, n, words, ends = (table[c].to_pylist() for c in ("key", "conv_id", "n", "words", "ends"))
    f, m = Forest(keys), len(keys)
    size = len(f.depth)

    def prefixes(key: str, upto: int | None) -> list[str]:
        h, out = hashlib.sha256(), []
        for d in range(-1 if upto is None else upto + 1):
            h.update(key[WIDTH * (d - 1) : WIDTH * d].encode() if d else b"")
            out.append(h.copy().hexdigest()[:WIDTH])
        return out

    names_left, names_right = prefixes(keys[0], left), prefixes(keys[-1], right)
    from_left = [f.low[x] == 0 and f.depth[x] < len(names_left) for x in range(size)]
    shared = [from_left[x] or f.high[x] == m - 1 and f.depth[x] < len(names_right) for x in range(size)]
    name = [(names_left if from_left[x] else names_right)[f.depth[x]] if shared[x] else None for x in range(size)]
    count, least = n + [0] * (size - m), conv + [None] * (size - m)
    below, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    last = [words[f.low[x]][f.depth[x] - 1] if f.depth[x] else 0 for x in range(size)]
    for x in sorted(range(size), key=lambda x: -f.depth[x]):
        if not shared[x]:
            leaves[x] += below[x] == 0
            saved[x] += (count[x] - 1) * last[x]
        p = f.parent[x]
        if p >= 0:
            below[p] += 1
            children[p] += not from_left[x]
            count[p] += count[x]
            least[p] = least[x] if least[p] is None else min(least[p], least[x])
            leaves[p] += leaves[x]
            saved[p] += saved[x]
    up = f.parent
    return {
        "part": [part] * size, "depth": f.depth, "conv_id": least, "parent_conv_id": [least[p] if p >= 0 and not shared[p] else None for p in up], "n_convs": count, "n_children": children,
        "n_leaves": leaves, "saved": saved, "words": last, "ends": ends + [None] * (size - m), "key": name, "parent_key": [name[p] if p >= 0 else None for p in up], "shared": shared,
    }


def ranges(distinct: DataFrame) -> DataFrame:
    """``distinct`` with part: sorted ranges of about ``RANGE`` turns."""
    turns = distinct.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranged = distinct.repartitionByRange(max(1, -(-turns // RANGE)), "key")
    return materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")


def boundaries(ranged: DataFrame) -> dict[int, tuple[int | None, int | None]]:
    """For each range the turns that its first and its last sequence share with the ranges beside it."""
    edge = materialize(ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")), "edges")
    parts = sorted(r[0] for r in edge.select("part").collect())
    following = edge.sparkSession.createDataFrame(list(zip(parts, parts[1:])), "part int, following int")
    pairs = edge.select("part", "last").join(following, "part").join(edge.select(F.col("part").alias("following"), "first"), "following")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [shared_turns(x.as_py(), y.as_py()) for x, y in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.int64())], ["part", "same"])

    same = dict(map(tuple, pairs.select("part", "last", "first").mapInArrow(run, "part int, same long").collect()))
    return {p: (same.get(before) if before is not None else None, same.get(p)) for before, p in zip([None, *parts], parts)}


def merged_nodes(forest: DataFrame, last_part: int) -> DataFrame:
    """Nodes that several ranges share, with the sums of their whole subtrees; key, parent_key and the columns of the result."""
    nodes = forest.filter("shared").groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.max("ends").alias("ends"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min("part").alias("owner"), F.max("part").alias("until"),
    )
    nodes = materialize(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "shared-nodes")
    own = dict(map(tuple, nodes.groupBy("owner").agg(F.sum("own")).collect()))
    before = [0]
    for p in range(last_part + 1):
        before.append(before[-1] + own.get(p, 0))
    sums = nodes.sparkSession.createDataFrame(list(enumerate(before)), "p int, before long")
    deeper = F.sum("own").over(Window.partitionBy("owner").orderBy(F.desc("depth")))  # those of one range are on one path
    nodes = nodes.withColumn("saved", F.col("saved") + deeper).withColumn("p", F.col("owner") + 1)
    nodes = nodes.join(sums.withColumnRenamed("before", "start"), "p").drop("p").join(sums.withColumnRenamed("p", "until"), "until")
    return materialize(nodes.withColumn("saved", F.col("saved") + F.greatest(F.col("before") - F.col("start"), F.lit(0))), "merged-nodes")


def trie(sequences_: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences (conv_id, t)."""
    key = F.array_join(F.transform("t", lambda t: t["digest"]), "")
    members = materialize(sequences_.select("conv_id", key.alias("key"), F.transform("t", lambda t: t["words"]).alias("words")), "members")
    seq = F.substring(F.sha2("key", 256), 1, WIDTH)
    per = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words")).withColumn("seq", seq)
    distinct = materialize(per.join(ends_of(members.select("conv_id", seq.alias("seq"))), "seq").drop("seq"), "sequences")
    ranged = ranges(distinct)
    beside = boundaries(ranged)
    if not beside:
        return sequences_.sparkSession.createDataFrame([], SCHEMA)
    names = [c.split()[0] for c in FOREST.split(",")]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found = range_rows(part, group, *beside[part])
        kinds = {"part": pa.int32(), "ends": pa.string(), "key": pa.string(), "parent_key": pa.string(), "shared": pa.bool_()}
        return pa.table({c: pa.array(found[c], kinds.get(c, pa.int64())) for c in names})

    forest = materialize(ranged.groupBy("part").applyInArrow(run, FOREST), "forest")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    complete = forest.filter("NOT shared")
    out = complete.filter("parent_key IS NULL").select(*columns)
    if len(beside) == 1:
        return out
    merged = merged_nodes(forest, max(beside))
    known = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    # Named once for each range, so that the children of the root are dealt out by range.
    near = forest.filter("shared").select("part", F.col("key").alias("parent_key")).join(known, "parent_key")
    below: Column = F.col("parent").alias("parent_conv_id")
    children = complete.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(near, ["part", "parent_key"]).withColumn("parent_conv_id", below)
    shared = merged.join(known, "parent_key", "left").withColumn("parent_conv_id", below)
    return out.unionByName(children.select(*columns)).unionByName(shared.select(*columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations."""
    return trie(with_family_heads(sequences(conversations)))
