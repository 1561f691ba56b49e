"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each, over the whole text). A passage is encoded by style rates and a
hashed histogram of word shapes; a learned layer maps it to ``h``. Gated attention weighs the passages of a document,
``a = softmax(w . (tanh(V h) * sigmoid(U h)))``, and the document's score is a logistic output of ``sum(a * h)``. Only
document labels supervise it: the attention finds the passages that decide.

The fit takes a bounded sample of labelled rows (``FIT_ROWS``, by hash of the id) with their whole texts; their encoded
passages, not the texts, reach the driver, where Adam on NumPy trains with class weights. Scoring is one pass over all
documents without a shuffle.

Defined cases: a null text counts as empty; an empty text is one passage without words; without labels of both kinds every
score is the share of good labels (0.5 without any); a document labelled twice counts with its lowest label; repeated rows
score alike; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash, text_or_empty

FIT_ROWS = 3000
PASSAGE = 96
SHAPES = 24
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY, SEED = 220, 0.02, 1e-4, 31

_RATES = 9
_RUNS = re.compile(rb"(.)\1+")
_KIND = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_HIGH = bytes(range(128, 256))
_shapes: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    """Bucket of a word's shape: kinds of characters, runs collapsed."""
    kinds = word.translate(_KIND)
    if kinds not in _shapes:
        if len(_shapes) > 100_000:
            _shapes.clear()
        _shapes[kinds] = zlib.crc32(_RUNS.sub(rb"\1", kinds)) % SHAPES
    return _shapes[kinds]


def encode(text: str) -> np.ndarray:
    """One row of features for each passage."""
    words = text.encode("utf-8", "surrogatepass").split()
    out = []
    for at in range(0, max(len(words), 1), PASSAGE):
        own = words[at : at + PASSAGE]
        n = max(len(own), 1)
        run = b" ".join(own)
        upper = len(run) - len(run.translate(None, _UPPER))
        lower = len(run) - len(run.translate(None, _LOWER))
        high = len(run) - len(run.translate(None, _HIGH))
        digits = len(run) - len(run.translate(None, b"0123456789"))
        marks = len(run) - len(run.translate(None, b".,;:!?'\""))
        rest = len(run) - upper - lower - high - digits - marks - (len(own) - 1 if own else 0)
        shapes = np.bincount([_shape(w) for w in own], minlength=SHAPES)[:SHAPES] / n
        rates = (
            len(set(own)) / n if own else 1.0,
            sum(map(bytes.__eq__, own, own[1:])) / n,
            upper / max(upper + lower + high, 1),
            min(marks / n, 3.0),
            min(rest / n, 3.0),
            min(digits / n, 3.0),
            min(len(run) / n, 40.0) / 10,
            run.count(b"!") / n,
            len(own) / PASSAGE,
        )
        out.append(np.concatenate([rates, shapes]))
    return np.array(out, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """The model; bags are rows of x with the start of each bag in ``starts``."""

    def __init__(self, d: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        g = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        self.p = {"W": g(d, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "k": np.zeros(1)}
        self.mean, self.std = np.zeros(d), np.ones(d)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["k"][0])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, starts)
        bag, h, t, s, a = f["bag"], f["h"], f["t"], f["s"], f["a"]
        d = weight * (f["y"] - y)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ d, "k": np.array([d.sum()])}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> "GatedAttention":
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.std
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, epochs + 1):
            for k, g in self.gradients(x, starts, y, weight).items():
                g = g + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward((np.concatenate(bags) - self.mean) / self.std, starts)["y"]


class Constant:
    """What is left to say without labels of both kinds."""

    def __init__(self, y: float):
        self.y = y

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.full(len(bags), self.y)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> GatedAttention | Constant:
    """Fit on at most ``fit_rows`` of the labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = sample_by_hash(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), fit_rows, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [encode(t.as_py()) for t in b.column("text")]
            columns = [b.column("doc_id"), b.column("quality"), pa.array([len(x) for x in bags], pa.int32()), pa.array([x.tobytes() for x in bags], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "n", "x"])

    rows = texts.select("doc_id", "quality", "text").mapInArrow(encoded, "doc_id long, quality int, n int, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "n", "x"]).drop_duplicates("doc_id")  # of several texts the same one on every run
    y = rows["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, _RATES + SHAPES).astype(float)
    starts = np.cumsum([0, *rows["n"].to_numpy()[:-1]])
    return GatedAttention(x.shape[1]).fit(x, starts, y)


def score(docs: DataFrame, model: GatedAttention | Constant) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                y = model.score([encode(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scored, "doc_id long, score double")
