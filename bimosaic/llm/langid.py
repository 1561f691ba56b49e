"""Language identification by rank-order n-gram profiles.

A profile is the ``TOP`` most frequent letter n-grams (one to three letters, words padded with a blank) of a language, in order.
A document is ranked the same way over its whole text; its distance to a profile is the sum, over its own top n-grams, of how
far each is out of place (``TOP`` for an n-gram that the profile lacks). The nearest profile names the language.

Profiles are learned from a bounded sample: at most ``DOCS_PER_LANGUAGE`` labelled documents of each language, those with the
smallest hash of their id, with their whole texts.

Defined cases: null text and text without a letter are ``und`` with score 0, as is everything if nothing was learned; equal
distances go to the language that sorts first; equal counts rank by n-gram code; repeated rows are judged alike; an empty
table gives an empty result. ``keep_known`` leaves all columns of its input as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

TOP = 400
DOCS_PER_LANGUAGE = 400
#: Below this nearness a text is like none of the learned languages, and the filter rejects it.
MIN_NEARNESS = 0.02

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SHIFT = np.int64(21)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, _NOT_LETTERS.sub("", text)))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and their counts."""
    padded = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = c != 32
    two = (c[:-1] << _SHIFT) | c[1:]
    three = ((two[:-1] << _SHIFT) | c[2:])[letter[1:-1]]
    return np.unique(np.concatenate([c[letter], two, three]), return_counts=True)


def ranked(text: str, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    codes, counts = ngrams(text)
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Ranks of all profile n-grams: one row per language, ``top`` where a profile lacks the n-gram."""

    def __init__(self, by_language: dict[str, list[int]], top: int):
        self.top, self.names = top, sorted(by_language)
        self.codes = np.array(sorted({c for v in by_language.values() for c in v}), np.int64)
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for row, name in zip(self.ranks, self.names, strict=True):
            row[np.searchsorted(self.codes, by_language[name])] = np.arange(len(by_language[name]))

    def distances(self, text: str) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        codes = ranked(text, self.top)
        at = np.searchsorted(self.codes, codes)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != codes] = len(self.codes)
        ranks = self.ranks[:, at]
        out = np.where(ranks < 0, self.top, np.minimum(np.abs(ranks - np.arange(len(codes))), self.top))
        return out.sum(1) / (self.top * max(len(codes), 1))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (margin to the second language, 0 to 1) and nearness (1: ranks as the profile)."""
        if not self.names or not has_letter(text):
            return "und", 0.0, 0.0
        d = self.distances(text)
        best = int(np.argmin(d))
        second = np.partition(d, 1)[1] if len(d) > 1 else 1.0
        return self.names[best], float((second - d[best]) / second) if second > 0 else 0.0, float(1 - d[best])


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, top: int = TOP) -> Profiles:
    """Profiles from the rows of ``docs`` that have a language and a text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", F.lit(5)).alias("h"))
    counts = known.groupBy("lang").count()
    # A hash threshold first leaves a few times the wanted rows, so that no task sorts a whole language.
    share = F.least(F.lit(1.0), F.lit(4.0 * docs_per_language) / F.col("count"))
    few = known.join(F.broadcast(counts), "lang").filter((F.col("h").cast("double") / F.lit(2.0**63) + 1) / 2 <= share)
    pick = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("n") <= docs_per_language)
    texts = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(pick.select("doc_id", "lang")), ["doc_id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    codes, n = ngrams(text)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    grams = texts.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = grams.withColumn("rank", rank).filter(F.col("rank") <= top).orderBy("lang", "rank").collect()
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["code"])
    return Profiles(found, top)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score, nearness of every document."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [profiles.predict(t.as_py()) for t in b.column(1)]
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "lang_pred", "score", "nearness"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, nearness double")


def keep_known(docs: DataFrame, profiles: Profiles, min_nearness: float = MIN_NEARNESS) -> DataFrame:
    """``docs`` without the rows whose language is not recognised; one pass, no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = [lang != "und" and near >= min_nearness for lang, _, near in (profiles.predict(t.as_py()) for t in b.column("text"))]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
