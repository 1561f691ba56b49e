"""The prefix trie, whitening and Golay-code deduplication against plain Python and NumPy, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from bimosaic.llm import golay_dedup, prefix_trie, whitening

# prefix trie

TURNS = "conv_id long, turn long, role string, text string, key string, t string, part int"


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = own.get(family, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            n = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": []})
            n["members"].append(c)
            if d == len(path):
                n["ends"].append(c)
    out = []
    for p, n in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = [q for q in below if not any(r[: len(q)] == q for r in nodes if len(r) == len(q) + 1)]
        saved = sum((len(nodes[q]["members"]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        out.append((
            min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(n["members"]), sum(len(q) == len(p) + 1 for q in below), len(leaf), saved,
            hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(seed: int, n: int):
    r = random.Random(seed)
    texts = [None, "", "one", "two words", " three  little\twords ", "x" * 50]
    rows = []
    for c in range(-5, n):
        for turn in range(r.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c * r.choice([1, 1, 3]), turn if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(texts[: r.choice([2, 4, 6])])))
    rows += rows[:5] + [(None, 0, "user", "lost"), (10_000, 0, "user", "alone")]
    long = [(20, t, "user", f"w {t // 7}") for t in range(120)]
    return rows + long + [(24 + k, t, "user", f"w {t // 7}") for k in range(6) for t in range(3, 120 - k)]


@pytest.mark.parametrize("size", [25_000, 40, 3])
def test_trie_matches_plain_python(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "RANGE", size)
    monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    rows = conversations(size, 70)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "k", "t", 1) for r in rows], TURNS)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_of_copies_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE", 5)
    rows = [(20 * c, t, "user", f"t{t}") for c in range(300) for t in range(3)]  # every head is the family's own
    got = sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame([(*r, "", "", 0) for r in rows], TURNS)).collect()), key=lambda r: r[1])
    ends = hashlib.sha256(",".join(str(20 * c) for c in range(300)).encode()).hexdigest()
    assert [r[1:7] for r in got] == [(d, 0 if d else None, 300, int(d < 3), 1, 299 * (3 - max(d - 1, 0))) for d in range(4)]
    assert [r[7] for r in got] == [prefix_trie.NO_ENDS] * 3 + [ends]
    empty = prefix_trie.prefix_trie(spark.createDataFrame([], TURNS))
    assert empty.collect() == [] and empty.columns == [c.split()[0] for c in prefix_trie.SCHEMA.split(", ")]


# whitening

VECTORS = "vec_id long, embedding array<double>, id string, x long, n long"


def whitened(spark, vectors, **k):
    rows = spark.createDataFrame([(i, v, "a", 0, 0) for i, v in enumerate(vectors)], VECTORS).repartition(3)
    return whitening.whiten(rows, **k).orderBy("vec_id", "component").collect()


def expected(vectors, k):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return y @ v[:, :k] / np.sqrt(e[:k]), e / e.sum(), ((n * x - s) ** 2).sum(1)


def test_whitening_matches_numpy(spark):
    r = np.random.default_rng(3)
    good = (r.normal(size=(400, 6)) @ r.normal(size=(6, 6)) * [900, 50, 4, 1, 0.4, 0.2]).tolist()
    bad = [None, [None] * 6, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]]
    vectors = good[:200] + bad + good[200:] + good[:3]
    got = whitened(spark, vectors, components=4)
    kept = [i for i, v in enumerate(vectors) if not any(v is b for b in bad)]
    assert [(g["vec_id"], g["component"]) for g in got] == [(i, c) for i in kept for c in range(1, 5)]
    w, share, deviation = expected([vectors[i] for i in kept], 4)
    mine = np.array([g["whitened"] for g in got]).reshape(-1, 4)
    mine *= np.sign((mine * w).sum(0))
    assert np.abs(mine - w).max() < 1e-7
    assert {g["n"] for g in got} == {len(kept)} and [g["deviation"] for g in got[::4]] == deviation.tolist()
    assert np.allclose([g["explained"] for g in got[:4]], share[:4], rtol=1e-9)
    assert got[0]["identity_error"] == pytest.approx(np.abs(mine.T @ mine / len(mine) - np.eye(4)).max(), abs=1e-12) and got[0]["identity_error"] < 1e-9


def test_whitening_of_wide_conditions(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(500, 5)) * [1e9, 1e5, 10, 1, 0.1]
    got = whitened(spark, base.tolist())
    mine = np.array([g["whitened"] for g in got]).reshape(-1, 5)
    assert np.abs(mine.T @ mine / 500 - np.eye(5)).max() < 1e-6 and np.abs(mine.mean(0)).max() < 1e-6
    assert np.abs(np.corrcoef(mine[:, 0], base[:, 0])[0, 1]) > 1 - 1e-9


def test_whitening_of_dependent_equal_single_and_no_vectors(spark):
    r = np.random.default_rng(5)
    a = r.integers(-900, 900, (60, 2)) / 64
    dependent = np.column_stack([a, a.sum(1), np.full(60, 2.0)]).tolist()  # two directions vary
    got = whitened(spark, dependent)
    assert {g["component"] for g in got} == {1, 2} and sum(g["explained"] for g in got[:2]) == pytest.approx(1)
    assert got[0]["identity_error"] < 1e-12
    assert whitened(spark, [[1.0, 2.0]] * 4) == [] and whitened(spark, [[1.0, 2.0]]) == [] and whitened(spark, []) == [] and whitened(spark, [None]) == []
    with pytest.raises(ValueError, match="entries"):
        whitened(spark, [[1.0], [1.0, 2.0]])


def test_deviations_beyond_a_long_are_null_and_others_exact(spark):
    got = whitened(spark, [[2.0**40, 0.0], [0.0, 1.0], [1.0, 0.0]], components=1)
    x = [[2**46 + 10**6, 10**6], [10**6, 10**6 + 64], [10**6 + 64, 10**6]]
    s = [sum(v) for v in zip(*x)]
    exact = [sum((3 * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    assert [g["deviation"] for g in got] == [v if v < 2**63 else None for v in exact]


# Golay-code deduplication

DOCS = "doc_id long, text string, fp string, key string, component string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(names, fps):
    label = dict(zip(names, names))
    for i, a in enumerate(names):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                old, new = max(label[a], label[names[j]]), min(label[a], label[names[j]])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_every_code_word_neighbourhood():
    patterns, n = golay_dedup.golay_errors()
    assert sorted(np.bincount(n).nonzero()[0]) == [1, 6] and n.sum() == 277 + 6 * 1771
    code = golay_dedup.Golay()
    v = np.arange(0, 1 << 23, 997)
    found, there = code.near(v)
    for flips in [(), (3,), (0, 22), (5, 17)]:
        w = v ^ sum(1 << b for b in flips)
        other, other_there = code.near(w)
        assert ((found[:, :, None] == other[:, None, :]) & there[:, :, None] & other_there[:, None, :]).any((1, 2)).all()


def test_all_patterns_of_three_bits_share_a_key():
    code = golay_dedup.Golay()
    base = np.random.default_rng(9).integers(-(1 << 63), 1 << 63, 4, dtype=np.int64)
    flips = [sum(1 << b for b in p) for k in range(4) for p in __import__("itertools").combinations(range(64), k)]
    flips = np.array(flips, np.uint64).view(np.int64)
    for f in base:
        own = golay_dedup.keys_of(np.array([f]), code)[1]
        at, keys = golay_dedup.keys_of(f ^ flips, code)
        assert len(np.unique(at[np.isin(keys, own)])) == len(flips)


def test_links_match_all_pairs_in_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(golay_dedup, "BLOCK", 50)
    r = random.Random(2)
    fps = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    found = golay_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    label = {x: x for x in fps}
    label |= {row["node"]: row["component"] for row in golay_dedup.components(found).collect()}
    assert label == plain_components(fps, [x % (1 << 64) for x in fps])


def test_golay_dedup_matches_plain_python(spark):
    r = random.Random(1)
    base = " ".join(f"w{r.randint(0, 500)}" for _ in range(400))
    texts = [None, "", " \n", "One", "one", "a b", "A B", base, base.upper(), base + " tail", base + " tail", base.replace("w1 ", "W1\t"), "é 日本 x y", "x " * 30_000]
    for k in range(60):
        words = base.split()
        words[r.randrange(400)] = f"new{k}"
        texts.append(" ".join(words))
    ids = [5 * i + 7 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in zip(ids, texts)], DOCS)
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in golay_dedup.near_duplicates(rows).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    label = plain_components(ids, fps)
    assert got == {i: (f"{f:016x}", label[i]) for i, f in zip(ids, fps)}


def test_golay_dedup_of_null_ids_and_nothing(spark):
    rows = [(None, "q w e r", "", "", ""), (9, "q w e r", "", "", ""), (9, "q w e r", "", "", ""), (None, "zz yy xx", "", "", "")]
    got = sorted((str(x["doc_id"]), str(x["component_id"])) for x in golay_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("9", "9"), ("9", "9"), ("None", "9"), ("None", "None")]
    assert golay_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
