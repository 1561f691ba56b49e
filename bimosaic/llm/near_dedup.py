"""Near-duplicate detection by a chosen-path set similarity join.

A document is the set of its 5-word shingles (64-bit hashes, over the whole text). Rows with equal sets are merged first.
Each of ``TREES`` independent trees branches the remaining sets: a set goes to the child named by its smallest token under one
random order (a minwise position of its signature). Sets alone in a node are done.

Large groups of copies stay together on every path, so they are tied first: each set goes to the smallest of its large root nodes,
and the sets of a node that look like its centre (the set that agrees best with the node's most frequent sketch bytes) are
confirmed against it. Ties are confirmed links on full sets; they only save work, since pairs in one confirmed component need no
further comparison.

A node is small when its pairs that are not in one component take at most ``LEAF`` comparisons a set; it is compared exhaustively.
Other nodes branch again, each time into two children per set so that similar pairs survive; those that are not small after
``DEPTH`` levels are compared in full all the same, as pairs of blocks. So no pair that shares a last node is left out. A pair of
similarity 0.75 shares a first node with probability 1 - 0.25**TREES = 0.99998. Where all its nodes stay large, it survives a
branching with probability 1 - (0.25 + 0.75 * q)**2 (q: the loss of the branchings below), three of them and the root with 0.675,
and so meets in some tree with 1 - 0.325**TREES = 0.9998; every branching of a tree has minwise positions of its own.

Comparison in a node uses sketches (one byte of each minwise token) and keeps pairs that may reach the threshold; they form
candidate groups. Then full sets are compared: every two sets of a group that are not in one component yet, as one block or as pairs
of blocks. That costs about the group's size where a centre ties it together, and at worst the square. Only confirmed links count:
the components are those of links with 100 * intersection >= 75 * union on full sets. A comparison emits one pair for each set
but the smallest of its components, never all pairs.

Defined cases: with fewer than five words the whole sequence is the only shingle; without words or text the set is empty and
links with nothing; equal sets link (whatever their size above 0); repeated rows are one set; rows that share a doc_id but not a
text are compared as the texts they are, and each has its own component_id; a null doc_id is compared and links others, but the
component's name is the smallest doc_id that is not null, and null only where there is none; an empty table gives an empty result.
``keep_one`` leaves all columns of its input as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_bits, materialize, maybe_among, slices, unused

WORDS = 5
THRESHOLD = (75, 100)
HASHES = 128
TREES = 8
LEAF = 512
DEPTH = 4
#: Minwise tokens that paths use: for each tree a root and two for each node of a binary tree above the last level.
PATH_TOKENS = TREES * (2**DEPTH - 1)
#: Signatures that agree less than this are below the threshold for all but one in ten thousand pairs (four standard errors).
MAYBE = 0.60
#: A block of full sets holds about this many sets, or elements, at most (a pair of blocks: twice that).
GROUP_SETS, GROUP_ELEMENTS = 128, 1_000_000
#: Sets in a block where a group or node is compared as pairs of blocks, and in the sample that a group's centre comes from.
BLOCK, SAMPLE = 256, 128

_ORDERS = np.random.default_rng(20_011).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct hashes of the word shingles, made of the hashes of their words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six white-space characters
    if not words:
        return np.empty(0, np.uint64)
    of = xxhash.xxh3_64_intdigest
    h = np.array([of(w) for w in words], np.uint64)
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest element under random orders: 32 bits of it for paths, one byte of each of ``HASHES`` orders for comparison."""
    out = np.empty(HASHES, np.uint32)
    for at in range(0, HASHES, 16):
        out[at : at + 16] = ((s[None, :] * _ORDERS[at : at + 16, None]).min(1) >> np.uint64(32)).astype(np.uint32)
    return out[:PATH_TOKENS], (out & np.uint32(255)).astype(np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), sig (path tokens), sketch."""

    def of(text: str | None) -> tuple:
        s = shingles(text)
        if not len(s):
            return 0, None, None, None
        return len(s), _digest(s), *(x.tobytes() for x in signature(s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for b in slices(batches):
            found = list(zip(*(of(t.as_py()) for t in b.column(1)), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found, kinds)], ["doc_id", "n_shingles", "set_key", "sig", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, sketch binary")


def _token(position: F.Column) -> F.Column:
    """Token at a position of the signature. Root of tree t: t; node h of its binary tree (its root 1, children 2 h and 2 h + 1): TREES + t * (2**DEPTH - 2) + h - 2."""
    return F.substr("sig", (4 * position + 1).cast("int"), F.lit(4))


def roots(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """rep, label, tree, at (position in the tree), node: the first nodes of every set; reps: rep, sig and, where sets are tied, label."""
    if "label" not in reps.columns:
        reps = labelled(reps, None)
    first = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), _token(F.lit(t))).alias("node")) for t in range(trees)])
    at = reps.select("rep", "label", F.explode(first).alias("b"))
    return materialize(at.select("rep", "label", "b.tree", F.lit(1).alias("at"), "b.node"), "paths")


def large(at: DataFrame, leaf: int = LEAF) -> DataFrame:
    """node, n: the nodes of more than twice ``leaf`` sets."""
    return materialize(at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * leaf), "large-nodes")


def mixed(at: DataFrame, tied: bool, rows: int | None = None) -> DataFrame:
    """``at`` in the nodes where sets of several labels meet, with n, the sets in the node, and pairs, those of different labels; others are done. tied: sets may share a label."""
    if tied:
        per = at.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("node")
        per = per.agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("same"))
    else:
        per = at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.col("n").cast("double"))
    pairs = (F.col("n").cast("double") * F.col("n") - F.col("same")) / 2
    return materialize(at.join(per.select("node", "n", pairs.alias("pairs")).filter("pairs > 0"), "node"), "nodes", rows=rows)


def homes(at: DataFrame, nodes: DataFrame, sets: int | None = None) -> DataFrame:
    """grp, rep, n: the smallest large node (node, n) of each set that has one, and how many sets are at home there."""
    home = at.join(nodes, "node").groupBy("rep").agg(F.min(F.struct("n", "node")).alias("h"))
    home = materialize(home.select("rep", F.col("h.node").alias("grp")), "homes", rows=sets)
    return home.join(home.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "grp").select("grp", "rep", "n")


def labelled(rows: DataFrame, tied: DataFrame | None) -> DataFrame:
    """``rows`` with label: the component (of rep, label) that a set is known to be in, or the set itself."""
    if tied is None:
        return rows.withColumn("label", F.col("rep"))
    found = rows.join(tied.withColumnRenamed("label", "known"), "rep", "left")
    return found.withColumn("label", F.coalesce("known", "rep")).drop("known")


def in_each(places: DataFrame, name: str, sets: DataFrame) -> DataFrame:
    """The distinct rows of ``places`` (name, rep) with the other columns of ``sets``: a set meets its row once, however many places it has."""
    per = places.groupBy("rep").agg(F.collect_set(name).alias("__places"))
    return per.join(sets, "rep").select(F.explode("__places").alias(name), *sets.columns)


def leaves(reps: DataFrame, at: DataFrame, tied: bool = False, leaf: int = LEAF) -> tuple[DataFrame, DataFrame | None]:
    """node, rep of the nodes of few sets; and grp, rep, label, open of larger nodes to compare across labels: those that this makes small, and the open ones that no level parts.

    Nodes of one label need no comparison and are left out."""
    done = crossed = None
    for level in range(1, DEPTH + 1):
        at = mixed(at, tied, at.count())
        small = at.filter(F.col("n") <= 2 * leaf).select("node", "rep")
        done = small if done is None else done.unionByName(small)
        rest = at.filter(F.col("n") > 2 * leaf).withColumn("open", F.col("pairs") > F.col("n") * leaf)
        if rest.isEmpty():
            break
        ready = rest if level == DEPTH else rest.filter("NOT open")
        ready = ready.select(F.col("node").alias("grp"), "rep", "label", "open")
        crossed = ready if crossed is None else crossed.unionByName(ready)
        rest = rest.filter("open")
        if level == DEPTH or rest.isEmpty():
            break
        place = lambda k: TREES + F.col("tree") * (2**DEPTH - 2) + 2 * F.col("at") + k - 2
        child = [F.struct((2 * F.col("at") + k).alias("at"), F.xxhash64("node", F.lit(k), _token(place(k))).alias("node")) for k in (0, 1)]
        rows = rest.count()
        if level == 1:  # later levels need the tokens of few sets
            reps = materialize(reps.select("rep", "sig").join(rest.select("rep").distinct(), "rep", "left_semi"), "branching", rows=rows)
        rest = in_each(rest.select("rep", F.struct("node", "label", "tree", "at").alias("place")), "place", reps).select("place.*", *reps.columns)
        at = materialize(rest.select("rep", "label", "tree", F.explode(F.array(*child)).alias("c")).select("rep", "label", "tree", "c.at", "c.node"), "paths", rows=2 * rows)
    return done, crossed


def dealt(rows: DataFrame) -> DataFrame:
    """node, rep: the sets of each group (grp, rep) in parts of about a block, each with the group's first set as a pivot."""
    per = rows.groupBy("grp").agg(F.min("rep").alias("pivot"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    per = materialize(per, "parts")
    parts = rows.join(per, "grp").select(F.xxhash64("grp", F.pmod(F.xxhash64("rep", "grp"), "parts")).alias("node"), "rep")
    pivots = per.select("grp", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k"))
    return parts.unionByName(pivots.select(F.xxhash64("grp", "k").alias("node"), F.col("pivot").alias("rep"))).distinct()


def cross_blocks(rows: DataFrame) -> DataFrame:
    """block, rep: blocks in which every two sets of a group meet that have different labels; rows: grp, rep, label, size (elements).

    A label of half a block's sets or more has blocks of its own, which are not paired among themselves; the others of a group share
    blocks. Groups of one label have none.
    """
    rows = materialize(rows, "labelled")
    per = rows.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    per = per.join(per.groupBy("grp").count().filter("count > 1").select("grp"), "grp")
    per = per.withColumn("owner", F.when(F.col("n") >= BLOCK // 2, F.col("label").cast("string")).otherwise(""))
    per = materialize(per, "labels")
    if per.isEmpty():
        return rows.limit(0).select(F.col("grp").alias("block"), "rep")
    parts = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("elements") / GROUP_ELEMENTS)).cast("long")
    parts = per.groupBy("grp", "owner").agg(parts.alias("parts"))
    dealt = rows.join(per.select("grp", "label", "owner"), ["grp", "label"]).join(parts, ["grp", "owner"])
    dealt = materialize(dealt.select("grp", "owner", F.pmod(F.xxhash64("rep", "grp"), "parts").alias("k"), "rep"), "dealt")
    own = F.struct("owner", "k")
    blocks = parts.select("grp", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k"))
    pairs = blocks.select("grp", own.alias("x")).join(blocks.select("grp", own.alias("y")), "grp")
    pairs = pairs.filter("x <= y AND (x.owner <> y.owner OR x.owner = '')").withColumn("block", F.xxhash64("grp", "x.owner", "x.k", "y.owner", "y.k"))
    sides = pairs.select("grp", "block", F.explode(F.array_distinct(F.array("x", "y"))).alias("b")).select("grp", "block", "b.owner", "b.k")
    return dealt.join(sides, ["grp", "owner", "k"]).select("block", "rep")


def tie_blocks(members: DataFrame, reps: DataFrame, sets: int | None = None) -> DataFrame:
    """block, rep: the sets of each group (grp, rep, n sets in it) that look like its centre, in blocks of bounded size that all have it.

    The centre agrees best with the most frequent bytes of a sample of the group's sketches; what is sampled decides only which
    sets are tied early.
    """
    rows = materialize(members.join(reps.select("rep", "sketch", "size"), "rep").select("grp", "rep", "n", "size", "sketch"), "members", rows=sets)
    some = rows.filter(F.pmod(F.xxhash64("rep", F.lit(3)), F.col("n")) < SAMPLE).groupBy("grp").agg(F.collect_list("sketch").alias("sketches"))

    def modes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bytes_ = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, HASHES) for x in b.column(1).to_pylist())
            out = [bytes(np.bincount(c).argmax() for c in m.T) for m in bytes_]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["grp", "mode"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (3, 4))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array((x == y).sum(1), pa.int64())], ["grp", "rep", "size", "same"])

    common = some.mapInArrow(modes, "grp long, mode binary")
    found = rows.join(common, "grp").select("grp", "rep", "size", "sketch", "mode").mapInArrow(agree, "grp long, rep long, size long, same long")
    near = materialize(found.filter(F.col("same") >= MAYBE * HASHES), "alike", rows=sets)
    most = F.ceil(F.greatest(F.count(F.lit(1)) / LEAF, F.sum("size") / GROUP_ELEMENTS)).cast("long")
    per = near.groupBy("grp").agg(F.max_by("rep", F.struct("same", -F.col("rep"))).alias("rep"), most.alias("parts"), F.count(F.lit(1)).alias("n"))
    per = materialize(per.filter("n > 1"), "centres", rows=sets)
    dealt = near.join(per.select("grp", "parts"), "grp").select(F.xxhash64("grp", F.pmod(F.xxhash64("rep", F.lit(9)), "parts")).alias("block"), "rep")
    copies = per.select("grp", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k")).select(F.xxhash64("grp", "k").alias("block"), "rep")
    return dealt.unionByName(copies).distinct()


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of the links, taken in order, that join two components."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if x == y:
            continue
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that span the same components as ``links``, each of a component's smallest member and another: labels need not travel along chains."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in links:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return [(root(x), x) for x in list(parent) if root(x) != x]


def _maybe_pairs(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a leaf whose signatures agree enough."""
    n = len(sketches)
    same = np.empty((n, n), np.uint8)
    for at in range(0, n, 64):
        same[at : at + 64] = (sketches[at : at + 64, None] == sketches[None]).sum(2, dtype=np.uint8)
    return np.nonzero(np.triu(same >= MAYBE * HASHES, 1))


def compared_leaves(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b: links that span the labels of each node (node, rep) whose sets may be similar; reps: rep, label, sketch."""
    # Nodes of the same sets, in several trees, are one leaf; nodes that get one name by chance are only compared together.
    leaf = F.bit_xor(F.xxhash64("rep")).over(Window.partitionBy("node"))
    own = nodes.select(leaf.alias("leaf"), "rep")
    rows = in_each(own, "leaf", reps.select("rep", F.struct("label", "sketch").alias("m"))).groupBy("leaf").agg(F.sort_array(F.collect_list("m")).alias("m"))
    rows = rows.select(F.transform("m", lambda x: x["label"]).alias("labels"), F.transform("m", lambda x: x["sketch"]).alias("sketches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            out = []
            for labels, sketches in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names, own = np.unique(np.array(labels, np.int64), return_inverse=True)
                x, y = _maybe_pairs(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), HASHES))
                x, y = own[x], own[y]
                out += _stars([(int(names[x[k]]), int(names[y[k]])) for k in _spanning(x, y, len(names))])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) of all nodes with links (a, b): each node hooks to the smallest label near it, and labels
    are followed to their own label, until nothing changes; rounds grow with the logarithm of the longest chain."""
    rows = 2 * links.count()  # no more nodes than that
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, f"{name}-links", rows=rows)
    label = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"), name, rows=rows)
    while True:
        ends = both.join(label.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b").groupBy("a").agg(F.min("cb").alias("near"))
        hop = label.join(ends, label["node"] == ends["a"]).select("node", "c", F.least("c", "near").alias("m"))
        # The label of a node's label learns the smaller one too, so long chains fold in a few rounds.
        lower = hop.groupBy("c").agg(F.min("m").alias("m")).withColumnRenamed("c", "node")
        new = hop.select("node", "c", "m").join(lower.withColumnRenamed("m", "m2"), "node", "left").select("node", "c", F.least("m", F.coalesce("m2", "m")).alias("m"))
        new = materialize(new, name, rows=rows)
        jump = new.select(F.col("node").alias("k"), F.col("m").alias("up"))
        after = new.join(jump, new["m"] == jump["k"], "left").select("node", F.coalesce("up", "m").alias("c"), (F.coalesce("up", "m") != F.col("c")).alias("moved"))
        after = materialize(after, name, rows=rows)
        if after.filter("moved").isEmpty():
            return after.select("node", F.col("c").alias("component"))
        label = after.select("node", "c")


def _full_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of a block under the threshold, from full sets."""
    num, den = THRESHOLD
    n = np.array([len(s) for s in sets])
    a, b = np.nonzero(np.triu(np.minimum(n[:, None], n) * den >= np.maximum(n[:, None], n) * num, 1))
    if not len(a):
        return []
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # others meet nothing
    who, at = np.repeat(np.arange(len(sets)), n)[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    meet, width = np.zeros((len(sets), len(sets)), np.int64), max(1, (1 << 22) // len(sets))
    for low in range(0, int(shared.sum()), width):
        part = slice(*np.searchsorted(at, [low, low + width]))
        m = np.zeros((len(sets), width if shared.sum() - low > width else int(shared.sum()) - low), np.float32)
        m[who[part], at[part] - low] = 1
        meet += (m @ m.T).astype(np.int64)
    both = meet[a, b]
    ok = both * den >= (n[a] + n[b] - both) * num
    a, b = a[ok], b[ok]
    return [(int(a[k]), int(b[k])) for k in _spanning(a, b, len(sets))]


def confirmed_links(docs: DataFrame, blocks: DataFrame, by_set: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of ``blocks`` (block, rep) that span the components of a block's links, which are confirmed on full sets; by_set has rep, set_key and first_id, a doc_id."""
    blocks = materialize(in_each(blocks, "block", by_set.select("rep", "set_key", "first_id")), "blocks")
    texts = maybe_among(_texts(docs), blocks.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", filter_bits(blocks.count()))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s for s in (shingles(t.as_py()) for t in b.column(1)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "full"])

    sets = texts.mapInArrow(full, "set_key binary, full binary").dropDuplicates(["set_key"])
    rows = blocks.select("block", "rep", "set_key").join(sets, "set_key").groupBy("block").agg(F.collect_list(F.struct("rep", "full")).alias("m"))
    rows = rows.select(F.transform("m", lambda x: x["rep"]).alias("reps"), F.transform("m", lambda x: x["full"]).alias("sets"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                reps_ = b.column(0)[k].as_py()
                links = _full_links([np.frombuffer(s.as_py(), np.uint64) for s in b.column(1)[k]])
                links = _stars([(reps_[x], reps_[y]) for x, y in links])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return materialize(rows.mapInArrow(compare, "a long, b long"), "links", 2)  # a row holds a block of full sets, up to 16 MB


def distinct_sets(rows: DataFrame) -> DataFrame:
    """rep (a number of its own), set_key, first_id (its smallest doc_id, or null), size, sig and sketch of every distinct set."""
    by_set = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    return materialize(by_set.withColumn("rep", F.monotonically_increasing_id()), "distinct-sets", rows=rows.count())


def set_links(docs: DataFrame, by_set: DataFrame, trees: int = TREES) -> DataFrame:
    """Confirmed links (a, b) that span the components of the distinct sets."""
    at, sets = roots(by_set, trees), by_set.count()
    links = tied = None
    crowded = large(at)
    if not crowded.isEmpty():
        links = confirmed_links(docs, tie_blocks(homes(at, crowded, sets), by_set, sets), by_set)
        if not links.isEmpty():
            tied = components(links, "tied").select(F.col("node").alias("rep"), F.col("component").alias("label"))
    reps = materialize(labelled(by_set.select("rep", "size", "sketch", "sig"), tied), "labelled-sets")
    if tied is not None:
        at = roots(reps, trees)

    nodes, crossed = leaves(by_set, at, tied is not None)
    if crossed is not None:  # what one part or the pivot ties into one candidate group need not be compared across the node
        crossed = materialize(crossed, "crossed")
        nodes = nodes.unionByName(dealt(crossed.filter("open")))
    maybe = materialize(compared_leaves(nodes, reps), "candidates", 64)
    group = components(maybe, "candidate-groups")
    if crossed is not None:
        label = group.select(F.col("node").alias("label"), "component")
        rows = crossed.join(label, "label", "left").select("grp", "rep", F.coalesce("component", "label").alias("label"), F.lit(0).alias("size"))
        more = materialize(compared_leaves(cross_blocks(rows).withColumnRenamed("block", "node"), reps), "candidates", 64)
        if not more.isEmpty():
            group = components(maybe.unionByName(more), "candidate-groups")
    group = materialize(reps.select("rep", "label", "size").join(group.select(F.col("node").alias("label"), F.col("component").alias("grp")), "label"), "candidate-groups", rows=sets)
    sizes = materialize(group.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements")), "group-sizes", rows=sets)
    is_large = (F.col("n") > GROUP_SETS) | (F.col("elements") > GROUP_ELEMENTS)
    blocks = group.join(sizes.filter(~is_large).select("grp"), "grp").select(F.col("grp").alias("block"), "rep")
    if not sizes.filter(is_large).isEmpty():
        blocks = blocks.unionByName(cross_blocks(group.join(sizes.filter(is_large).select("grp"), "grp")))
    found = confirmed_links(docs, blocks, by_set)
    return found if links is None else links.unionByName(found)


def near_duplicates(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = materialize(sets_of(docs), "shingle-sets")
    by_set = distinct_sets(rows)
    final = components(set_links(docs, by_set, trees))
    of_set = by_set.select("rep", "set_key", "first_id").join(final, by_set["rep"] == final["node"], "left")
    of_set = of_set.select("set_key", "first_id", F.coalesce("component", "rep").alias("label"))
    names = of_set.filter("label IS NOT NULL").groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_set = materialize(of_set.join(names, "label").select("set_key", "component_id"), "named-sets", rows=by_set.count())
    linked = rows.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    out = linked.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest doc_id.

    Rows without a doc_id stay, as no name tells them apart; rows that repeat doc_id and text are one; a doc_id with several texts
    stays as long as one of them represents its group.
    """
    found = materialize(near_duplicates(docs, trees).select("doc_id", "kept").filter("doc_id IS NOT NULL"), "near-duplicates")
    per = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = unused(docs, "gone")
    per = materialize(per.filter("NOT kept OR n > 1").withColumnRenamed("doc_id", gone), "gone")
    out = docs.join(per.filter("NOT kept").select(gone), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    if per.filter("kept").isEmpty():
        return out
    return out.filter(F.col("doc_id").isNull()).unionByName(out.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"]))
