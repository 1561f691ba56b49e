"""SimHash near-duplicate detection by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is set if more than half of the hashes of the text's word shingles (repeats included) have it.
Fingerprints link at ``DISTANCE`` = 3 or fewer differing bits. Two segments of 23 bits are decoded by the perfect binary Golay code:
a segment's keys are the numbers of all codewords within 4 bits, which is one codeword or six. Two segments that differ in two bits
or fewer share a key, as the codeword nearest to a point between them is within 4 of both. Let a, b, c be the differing bits of the
segments A (23 bits), B (23) and C (18, in halves C1 and C2), a + b + c <= 3. Then one of these keys is equal:

* a = 3: B and C as they are; b = 3: A and C as they are;
* c >= 2: of A and B one is equal and the other differs in one bit at most: A and a key of B, or a key of A and B;
* otherwise c <= 1, so one half of C is equal, and A and B differ in two bits at most: a key of A, a key of B, and C1 or C2.

That is some 69 keys of 33 bits or more for each distinct fingerprint, and no link is lost. Every candidate is verified on the
fingerprints. A key of two fingerprints is verified where it is counted; fingerprints of larger keys are compared in blocks of
bounded size, every two blocks of a key, and a comparison emits only links that span its components, never all pairs.
Equal fingerprints are one, whatever their number, so a group of copies costs nothing.

Defined cases: null texts and texts without words have fingerprint zero and link like any other; with fewer than three words the whole
sequence is the only shingle; rows that share a doc_id are compared as the texts they are; a null doc_id is compared and links
others, but names its component only where no other id is there; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_among, slices
from .near_dedup import _spanning, components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Generator polynomial of the binary Golay code, its length, and bits of a codeword that number it.
GENERATOR, LENGTH, MESSAGE = 0b110001110101, 23, 12
#: Fingerprints in a block, and hashes whose bits are counted at once.
BLOCK, CHUNK = 4096, 1 << 16
#: Fingerprints whose keys one task makes, about.
IN_TASK = 16_384
SCHEMA = "doc_id long, fp long"


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six white-space characters
    if not words:
        return 0
    k, joined, hash_of = min(WORDS, len(words)), b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _remainders(v: np.ndarray) -> np.ndarray:
    """v modulo the generator, as polynomials over two elements."""
    v = v.copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - LENGTH + MESSAGE), 0)
    return v


def golay_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder: the patterns of up to 4 bits that lead from a word with it to a codeword (6 columns), and how many there are."""
    at = [np.array([0])]
    for _ in range(4):  # patterns of one bit more: add a bit above the highest
        last = at[-1]
        at.append(np.concatenate([last[last < 1 << bit] | 1 << bit for bit in range(LENGTH)]))
    patterns = np.concatenate(at)
    left = _remainders(patterns)
    weight = np.repeat(np.arange(5), [len(a) for a in at])
    nearest = np.full(1 << (LENGTH - MESSAGE), 5)
    np.minimum.at(nearest, left, weight)
    keep = (nearest[left] == 3) | (weight < 4)  # a word within 2 of a codeword has no other within 4
    patterns, left = patterns[keep], left[keep]
    order = np.argsort(left, kind="stable")
    patterns, left = patterns[order], left[order]
    n = np.bincount(left, minlength=len(nearest))
    out = np.zeros((len(nearest), int(n.max())), np.int64)
    out[left, np.arange(len(left)) - (np.cumsum(n) - n)[left]] = patterns
    return out, n


class Golay:
    """Codeword numbers near 23-bit words."""

    def __init__(self) -> None:
        self.patterns, self.n = golay_errors()
        self.high = _remainders(np.arange(1 << MESSAGE) << (LENGTH - MESSAGE))

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word six numbers of codewords within 4 bits, and which of the six are there."""
        left = self.high[v >> (LENGTH - MESSAGE)] ^ (v & ((1 << (LENGTH - MESSAGE)) - 1))
        found = (v[:, None] ^ self.patterns[left]) >> (LENGTH - MESSAGE)
        return found, np.arange(self.patterns.shape[1]) < self.n[left][:, None]


def keys_of(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``fp`` and their keys (the kind of key in the top bits)."""
    v = fp.view(np.uint64)
    a = (v & np.uint64((1 << 23) - 1)).astype(np.int64)
    b = (v >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    c = (v >> np.uint64(46)).astype(np.int64)
    (na, ia), (nb, ib) = code.near(a), code.near(b)
    m = len(v)
    both, there = na[:, :, None] << 12 | nb[:, None, :], ia[:, :, None] & ib[:, None, :]
    parts = [
        (((both << 9) | (c & 511)[:, None, None]), there), (((both << 9) | (c >> 9)[:, None, None]) | 1 << 60, there),
        (a[:, None] << 12 | nb | 2 << 60, ib), (b[:, None] << 12 | na | 3 << 60, ia),
        ((b << 18 | c | 4 << 60)[:, None], np.ones((m, 1), bool)), ((a << 18 | c | 5 << 60)[:, None], np.ones((m, 1), bool)),
    ]
    keys = np.concatenate([k.reshape(m, -1) for k, _ in parts], 1)
    ok = np.concatenate([t.reshape(m, -1) for _, t in parts], 1)
    at, which = np.nonzero(ok)
    return at, keys[at, which]


def keyed(distinct: DataFrame) -> DataFrame:
    """key, fp: every key of every distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in slices(batches, 2048):
            fp = b.column(0).to_numpy()
            at, keys = keys_of(fp, code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def blocks_of(large: DataFrame, keys: DataFrame) -> DataFrame:
    """block, fp, side: the fingerprints of large keys (key, n), in blocks; every two blocks of a key meet once, side 0 and 1 (2: a block with itself)."""
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    rows = keys.join(large.select("key", parts.alias("parts")), "key")
    rows = rows.withColumn("k", F.pmod(F.xxhash64("fp", "key"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("o")
    met = rows.select("key", "fp", "k", other)
    block = F.struct("key", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"))
    return met.select(block.alias("block"), "fp", F.when(F.col("k") == F.col("o"), 2).when(F.col("k") < F.col("o"), 0).otherwise(1).alias("side"))


def block_links(blocks: DataFrame) -> DataFrame:
    """a, b: verified links that span the components of each block."""
    rows = blocks.groupBy("block").agg(F.collect_list(F.when(F.col("side") != 1, F.col("fp"))).alias("x"), F.collect_list(F.when(F.col("side") == 1, F.col("fp"))).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out: list[np.ndarray] = []
            for x, y in zip(b.column(0), b.column(1), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                own = not len(y)
                y = x if own else y
                found = []
                for at in range(0, len(x), 256):
                    p, q = np.nonzero(np.bitwise_count((x[at : at + 256, None] ^ y[None]).view(np.uint64)) <= DISTANCE)
                    p = p + at
                    found.append(np.stack([p[p < q], q[p < q]]) if own else np.stack([p, q + len(x)]))
                p, q = np.concatenate(found, 1)
                nodes = x if own else np.concatenate([x, y])
                keep = _spanning(p, q, len(nodes))
                out.append(np.stack([nodes[p[keep]], nodes[q[keep]]]))
            a, c = np.concatenate(out, 1) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return rows.select("x", "y").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links between the distinct fingerprints (fp) that span their components."""
    # A task gets so many fingerprints, not so many bytes, as each becomes some 69 keys.
    keys = keyed(distinct.select("fp").repartition(max(1, -(-distinct.count() // IN_TASK)), "fp"))
    per = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    per = materialize(per.filter(f"n > 2 OR bit_count(a ^ b) <= {DISTANCE}"), "shared-keys")
    pairs = per.filter("n = 2").select("a", "b").distinct()
    large = per.filter("n > 2").select("key", "n")
    if large.isEmpty():
        return materialize(pairs, "links")
    found = block_links(blocks_of(large, maybe_among(keys, large.select("key"), "key")))
    return materialize(pairs.unionByName(found).distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    rows = materialize(fingerprints(docs), "fingerprints")
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    final = components(links(first), "simhash").withColumnsRenamed({"node": "fp"})
    named = first.join(final, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(names, "component").select("fp", "component_id"), "named-fingerprints")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
