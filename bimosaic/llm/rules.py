"""Quality rules with an isolation forest over rule statistics.

Every whole text gives rule statistics. A forest of random splits is drawn inside the box that all labelled rows span, and every
clean row that grows it is counted in every tree; a row outside the clean region meets an empty cell after few splits, and its
short paths make it anomalous. The verdict's threshold is calibrated on labelled rows: the cut with the best balanced accuracy
among those that drop at most ``max_clean_loss`` of clean rows.

All labelled rows that pass the base rules take part: half of the clean ones (by hash of the id) grow the forest, the other half and
all the rest calibrate it. Tasks count and score; the driver sees counts per leaf and one cut, whatever the number of rows.

Defined cases: null text has no words and fails the base rules, as do texts under 50 words; without labelled rows of both
kinds the verdict keeps whatever passes the base rules; where a half of the clean rows is empty, the other serves for both; of equally
good cuts the highest counts; a document labelled twice counts with its lowest quality; repeated
rows are judged alike; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, DEPTH, SEED = 96, 10, 20
MAX_CLEAN_LOSS = 0.005
#: Ranges of scores that are summed apart when the cut is sought.
BUCKETS = 1 << 16

SYMBOLS = "#*$%&|<>"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long"
NAMES = [x.split()[0] for x in STATS.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly space, \t, \n, \v, \f and \r
    lines = [x for x in text.split("\n") if _SPACE.sub("", x)] if "\n" in text else [text] * bool(words)
    letters = re.sub(r"[\W\d_]+", "", text)
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(letters) - len(re.sub(r"[A-ZÀ-ÖØ-Þ]+", "", letters)),
        len(letters),
        text.count("!") + text.count("?"),
    )


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t.as_py()) for t in b.column(1)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(NAMES) - 1)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], NAMES)


def rule_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stats_batches, STATS)


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not depend on a text's length, one row per document."""
    per = lambda a, b: x[a] / np.maximum(x[b], 1)
    return np.stack([
        np.minimum(per("n_symbols", "n_words"), 1.0),
        per("n_repeat_words", "n_words"),
        np.minimum(per("word_chars", "n_words"), 40.0),
        per("n_upper", "n_letters"),
        np.minimum(per("n_marks", "n_words"), 1.0),
        per("n_letters", "word_chars"),
    ], axis=1)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Splits:
    """Complete random trees: each node cuts one feature at a point of its box. Node k has the children 2 k + 1 and 2 k + 2."""

    def __init__(self, low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide = np.flatnonzero(high > low)
        self.depth = depth
        self.feature = np.zeros((trees if len(wide) else 0, 2**depth - 1), np.int64)
        self.cut = np.zeros(self.feature.shape)
        for feature, cut in zip(self.feature, self.cut, strict=True):
            lo, hi = low[None].astype(float), high[None].astype(float)
            for d in range(depth):
                n = np.arange(2**d)
                f = rng.choice(wide, len(n))
                at = rng.uniform(lo[n, f], hi[n, f])
                feature[n + len(n) - 1], cut[n + len(n) - 1] = f, at
                lo, hi = lo.repeat(2, 0), hi.repeat(2, 0)
                hi[2 * n, f] = lo[2 * n + 1, f] = at

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (0 to 2**depth - 1) of every row, a line for each tree."""
        rows, out = np.arange(len(x)), np.empty((len(self.feature), len(x)), np.int64)
        for k, (feature, cut) in enumerate(zip(self.feature, self.cut, strict=True)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            out[k] = at - (2**self.depth - 1)
        return out

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Rows in every leaf, a line for each tree."""
        return np.array([np.bincount(k, minlength=2**self.depth) for k in self.leaves(x)], np.int64).reshape(-1, 2**self.depth)


class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, left child, right child, path length at leaves."""

    def __init__(self, clean: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int | None = None, depth: int = DEPTH, seed: int = SEED):
        """Grown on all rows of ``clean``, or on ``sample`` of them if that is given."""
        if sample and sample < len(clean):
            clean = clean[np.random.default_rng(seed).choice(len(clean), sample, replace=False)]
        splits = Splits(low, high, trees, depth, seed)
        self._grow(splits, splits.counts(clean), len(clean))

    @classmethod
    def counted(cls, splits: Splits, counts: np.ndarray, n: int) -> Forest:
        """The forest of ``n`` rows of which each leaf of the splits has so many."""
        out = cls.__new__(cls)
        out._grow(splits, counts, n)
        return out

    def _grow(self, splits: Splits, counts: np.ndarray, n: int) -> None:
        """Splits of nodes that hold more than one row; the others are leaves."""
        self.unit = float(_mean_path(max(n, 2)))
        self.trees = []
        depth = np.repeat(np.arange(splits.depth + 1), 2 ** np.arange(splits.depth + 1))
        for feature, cut, c in zip(splits.feature, splits.cut, counts, strict=True):
            levels = [c]
            while len(levels[0]) > 1:
                levels.insert(0, levels[0].reshape(-1, 2).sum(1))
            held = np.concatenate(levels)
            inner = np.flatnonzero((held > 1) & (depth < splits.depth))
            nodes = np.sort(np.concatenate([[0], 2 * inner + 1, 2 * inner + 2]))
            tree = np.zeros((len(nodes), 5))
            tree[:, 0], tree[:, 4] = -1, depth[nodes] + _mean_path(held[nodes])
            at = np.searchsorted(nodes, inner)
            tree[at, 0], tree[at, 1] = feature[inner], cut[inner]
            tree[at, 2], tree[at, 3] = np.searchsorted(nodes, 2 * inner + 1), np.searchsorted(nodes, 2 * inner + 2)
            self.trees.append(tree)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher: more anomalous."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:  # down to the leaves
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= t[at, 1]
                at = np.where(inner, np.where(right, t[at, 3], t[at, 2]).astype(np.int64), at)
            total += t[at, 4]
        return 2.0 ** (-total / len(self.trees) / self.unit)


def calibrate(scored: DataFrame, max_clean_loss: float = MAX_CLEAN_LOSS) -> float:
    """The anomaly above which a row is dropped, from all rows (quality, anomaly): ranks are exact, summed by ranges of scores."""
    per = scored.groupBy("anomaly").agg(F.count_if(F.col("quality") == 1).alias("clean"), F.count_if(F.col("quality") == 0).alias("junk"))
    per = materialize(per.withColumn("bucket", F.floor(F.col("anomaly") * BUCKETS)), "anomalies")
    clean, junk = per.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("junk"), F.lit(0))).first()
    lower = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # of at most one row a bucket
    sums = per.groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("junk").alias("j"))
    before = sums.select("bucket", *[F.coalesce(F.sum(k).over(lower), F.lit(0)).alias(k) for k in ("c", "j")])
    inside = Window.partitionBy("bucket").orderBy("anomaly")
    lost = F.lit(clean) - F.col("c") - F.sum("clean").over(inside)
    caught = F.lit(junk) - F.col("j") - F.sum("junk").over(inside)
    cuts = per.join(F.broadcast(before), "bucket").select("anomaly", lost.alias("lost"), (caught * clean - lost * junk).alias("gain"))
    best = cuts.filter((F.col("lost") <= max_clean_loss * clean) & (F.col("gain") > 0)).agg(F.max_by("anomaly", F.struct("gain", "anomaly"))).first()[0]
    if best is None:
        return math.inf
    return (best + per.filter(F.col("anomaly") > best).agg(F.min("anomaly")).first()[0]) / 2


FEATURES = [f"f{k}" for k in range(6)]


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, grows and the features of every labelled document that passes the base rules."""
    quality = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    quality = quality.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality IN (0, 1)")
    base = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    rows = stats.filter(base).groupBy("doc_id").agg(F.min(F.struct(*NAMES[1:])).alias("s")).join(quality, "doc_id")

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in NAMES[1:]})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), *map(pa.array, x.T)], ["doc_id", "quality", *FEATURES])

    rows = rows.select("doc_id", "quality", "s.*").mapInArrow(rates, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES))
    return materialize(rows.withColumn("grows", (F.col("quality") == 1) & (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2)) == 0)), "labelled-features")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)


def leaf_counts(rows: DataFrame, splits: Splits) -> np.ndarray:
    """How many of ``rows`` every leaf of every tree holds."""
    leaves = 2**splits.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(splits.feature), leaves), np.int64)
        for b in batches:
            held += splits.counts(_matrix(b))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.ravel()[at])], ["leaf", "n"])

    out = np.zeros(len(splits.feature) * leaves, np.int64)
    for leaf, n in rows.select(*FEATURES).mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():
        out[leaf] = n
    return out.reshape(-1, leaves)


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """A forest and its threshold from all labelled rows: half of the clean ones grow it, the others and the rest calibrate it."""
    rows = labelled(stats, labels)
    ends = [g(f).alias(f"{g.__name__}_{f}") for g in (F.min, F.max) for f in FEATURES]
    seen = rows.agg(F.count_if("grows").alias("grow"), F.count_if(F.col("quality") == 1).alias("clean"), F.count_if(F.col("quality") == 0).alias("junk"), *ends).first()
    if not seen["clean"] or not seen["junk"]:
        return None, math.inf
    low, high = (np.array([seen[f"{g}_{f}"] for f in FEATURES]) for g in ("min", "max"))
    halves = 0 < seen["grow"] < seen["clean"]
    splits = Splits(low, high)
    grow = rows.filter("grows" if halves else "quality = 1")
    forest = Forest.counted(splits, leaf_counts(grow, splits), seen["grow"] if halves else seen["clean"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(forest.score(_matrix(b)), pa.float64())], ["quality", "anomaly"])

    unseen = rows.filter("NOT grows") if halves else rows
    return forest, calibrate(unseen.mapInArrow(scored, "quality int, anomaly double"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document, base_failed, anomaly (0 to 1) and kept."""
    stats = materialize(rule_statistics(docs), "rule-statistics")
    forest, threshold = fit(stats, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in NAMES[1:]})
            s = forest.score(x) if forest else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "anomaly"])

    out = stats.mapInArrow(scored, STATS + ", anomaly double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") <= F.lit(threshold)))
