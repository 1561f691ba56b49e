"""Best-fit packing planned over the histogram of piece lengths.

Every document is tokenized once; documents longer than a sequence are cut into pieces. Only the histogram of piece lengths
(at most one row per length) goes to the driver, where best fit in falling order of length fills sequences class by class:
all sequences with the same room left form a class, so the plan is a short list of segments, whatever the number of
documents. Pieces then take the planned slots by their rank within their length; ranks come from counts per (length, hash
bucket), so no task holds all pieces of a common length.

Defined cases: null text is empty, an empty document is the single end token; repeated rows are pieces of their own; equal
lengths are ranked by hash bucket, doc_id and piece; an empty table gives no sequences. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty

SEQUENCE = 2048
END_ID = 0
MEMO = 150_000
ROWS_PER_BUCKET = 5000

#: White space besides blank and line feed, and blanks or line feeds that meet: such texts are encoded in one piece.
_ODD = tuple("\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(map(chr, range(0x2000, 0x200B))) + ("  ", " \n", "\n ", "\n\n")
_MARKS = ".,;:!?*#$%&"


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class Encoder:
    """Ids as little-endian 32-bit bytes, the same as the tokenizer gives for a whole text.

    A byte-level pre-tokenizer parts a text before a single blank or line feed between two other characters, and between a
    letter and a mark that follows it. So words can be encoded one by one, and as words recur, ``MEMO`` of them at most are
    remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(_byte_letters()))
        self.first, self.inner = _Words(self, ""), _Words(self, " ")
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters_only(self, word: str) -> bytes:
        """Ids of letters, maybe after a blank: one stretch for the vocabulary's merges, so no pre-tokenizer is needed."""
        if word.isascii():  # letters stand for themselves
            shown = word.replace(" ", self.letters[32])
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.special) or any(x in text for x in _ODD) or text[:1] in (" ", "\n", "") or text[-1] in " \n":
            return self.whole(text)
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out += (self.line_feed, self.first[words[0]])
            out += map(self.inner.__getitem__, words[1:])
        return b"".join(out[1:])


class _Words(dict):
    """Ids of words that stand after ``before``; those of a word with marks are put together from both.

    When half of ``MEMO`` words have come, they become the older half, whose words come back as they recur; the half before them goes.
    """

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before, self.older = encoder, before, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.encoder.letters_only(self.before + word)
            else:
                stem = word.rstrip(_MARKS)
                if stem != word and stem.isalpha():
                    return self[stem] + self.encoder.first[word[len(stem) :]]
                ids = self.encoder.whole(self.before + word)
        if len(word) <= 48:
            if len(self) >= MEMO // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``size``, only the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return [(0, first)] * bool(first) + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, the piece's ids as little-endian 32-bit bytes)."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 5 + with_ids]
    names = [x.split()[0] for x in schema.split(", ")]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        end = np.array([END_ID], "<u4").tobytes()
        for b in slices(batches):
            encoder = encoder or Encoder(tokenizer_path)
            rows = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc.as_py(), k, start, length, zlib.crc32(part), part)[: 5 + with_ids])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(tokenize, schema)


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, pieces, first sequence, pieces per sequence, offset) of a best fit in falling order.

    ``room[r]`` lists runs of sequences (first, number) with r free tokens; a piece goes where the least room is left.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = [r for r, runs in room.items() if r >= length and runs]
            free = min(fits, default=size)
            each = free // length
            if fits:
                first, n = room[free].pop()
            else:
                first, n = sequences, -(-left // each)
                sequences += n
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, each, size - free))
                room.setdefault(free - each * length, []).append((first, full))
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:  # the last pieces of this length share one sequence
                out.append((length, rank, left, first, left, size - free))
                room.setdefault(free - left * length, []).append((first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                room.setdefault(free, []).append((first, n))
        room.pop(0, None)
    return out


def slots(parts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``parts`` (columns of ``pieces``) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    segments = np.array(plan(counts, size), np.int64).reshape(-1, 6)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    buckets = max(1, sum(counts.values()) // ROWS_PER_BUCKET)
    key = sum(counts.values()) + 1

    rows = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.lit(3)), F.lit(buckets)))
    per = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    rows = rows.withColumn("own", own).join(per, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own"))
    names = list(parts.columns)
    rows = rows.select(*names, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = segments[:, 0] * key + segments[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            s = segments[np.searchsorted(starts, length * key + rank, "right") - 1]
            within = rank - s[:, 1]
            sequence, offset = s[:, 3] + within // s[:, 4], s[:, 5] + within % s[:, 4] * length
            columns = [b.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return rows.mapInArrow(place, kinds + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return slots(materialize(pieces(docs, tokenizer_path, size), "pieces"), size)


def packed_sequences(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """sequence_id, length and ids (little-endian 32-bit bytes) of every packed sequence."""
    placed = slots(materialize(pieces(docs, tokenizer_path, size, with_ids=True), "pieces"), size)
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"), F.sum("length").alias("length"))
    return whole.select("sequence_id", "length", F.unhex(F.array_join(F.transform("p", lambda p: p["ids"]), "")).alias("ids"))
