"""The pipeline against a plain chain of its five stages, columns that clash with helpers' names, and models computed by hand."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bimosaic.llm import exact_dedup, langid, mixing, near_dedup, pii, quality_mil, queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"aa": "ba be bi bo ka ke ki ko".split(), "zz": "zu zo xu xo vu vo wu wo".split()}


def prose(seed: int, n: int, lang: str = "aa") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_texts_whose_polynomial_hashes_collide_stay_apart(spark):
    texts = [thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a"), "w " + thue_morse(2048, "a", "b") + " x y z", "w " + thue_morse(2048, "b", "a") + " x y z"]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_shingles_depend_on_order_and_number_of_words():
    sets = [near_dedup.shingles(t).tolist() for t in ("a b", "b a", "a b c d e", "a b c d e f", "b c d e f", "a", "a a", "")]
    assert [len(s) for s in sets] == [1, 1, 1, 2, 1, 1, 1, 0]
    assert sorted(sets[2] + sets[4]) == sets[3] and len({x for s in sets for x in s}) == 7 - 1
    assert near_dedup.shingles("A\tB  c\nd\x0be").tolist() == sets[2]


# columns

HELPERS = (
    "id digest digest2 text_sha256 row row_no gone gone_ size key part copy epochs rest cut_key cut_size cut_words source_size source_rows target part_words "
    "__id __digest __digest2 __gone __size __key __part __copy __source __plan_rest __plan_epochs __plan_cut_key __row __found __new n count found label rep node"
).split()


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, near_dedup.keep_one, mixing.mixed_documents, lambda d: langid.keep_known(d, langid.learn(d)), lambda d: pii.pseudonymize(d, "k").drop("pii_found")])
def test_stages_pass_every_column_through(spark, stage):
    texts = [prose(1, 80), prose(1, 80), prose(2, 80), prose(2, 79) + " end", None, ""]
    rows = [(i, t, "aa", "s" if i % 2 else None, None, *[f"{h} {i}" for h in HELPERS]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{h}` string" for h in HELPERS))
    out = stage(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert kept
    for r in kept:
        assert [r[h] for h in HELPERS] == [f"{h} {r['doc_id']}" for h in HELPERS] and r["lang"] == "aa" and r["source"] == ("s" if r["doc_id"] % 2 else None)


def test_octets_with_leading_zeros_are_left_alone(spark):
    docs = spark.createDataFrame([(0, "from 01.2.3.4 and 1.2.3.4 and 1.2.3.04")], "doc_id long, text string")
    new = pii.pseudonymize(docs, "k").first()["text"].split()
    assert new[1] == "01.2.3.4" and new[5] == "1.2.3.04" and new[3] != "1.2.3.4"


# models by hand


def test_attention_forward_pass_by_hand():
    m = quality_mil.GatedAttention(3, seed=4)
    m.mean, m.std = np.array([0.1, -0.2, 0.3]), np.array([1.0, 2.0, 0.5])
    r = np.random.default_rng(1)
    bags = [r.normal(size=(k, 3)) for k in (1, 4, 2)]
    p, expected = m.p, []
    for bag in bags:
        hidden, energy = [], []
        for row in bag:
            x = [(v - a) / s for v, a, s in zip(row, m.mean, m.std)]
            h = [math.tanh(sum(x[i] * p["W"][i][j] for i in range(3)) + p["b"][j]) for j in range(p["W"].shape[1])]
            t = [math.tanh(sum(h[i] * p["V"][i][j] for i in range(len(h)))) for j in range(p["V"].shape[1])]
            s = [1 / (1 + math.exp(-sum(h[i] * p["U"][i][j] for i in range(len(h))))) for j in range(p["U"].shape[1])]
            hidden.append(h)
            energy.append(sum(a * b * w for a, b, w in zip(t, s, p["w"])))
        weights = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
        z = [sum(w * h[j] for w, h in zip(weights, hidden)) for j in range(len(hidden[0]))]
        expected.append(1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["k"][0]))))
    assert np.allclose(m.score(bags), expected, atol=1e-12)


def grams(text: str) -> collections.Counter:
    out = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def order(counts: collections.Counter, top: int) -> list[str]:
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def predicted(text, profiles, top):
    """Language and nearness from whole out-of-place distances."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    own, best = order(grams(text), top), None
    for lang in sorted(profiles):
        rank = {g: i for i, g in enumerate(profiles[lang])}
        d = sum(min(abs(rank[g] - i), top) if g in rank else top for i, g in enumerate(own)) / (top * len(own))
        if best is None or d < best[1]:
            best = lang, d
    return best[0], 1 - best[1]


def profiles_of(rows, top):
    return {lang: order(sum((grams(r[1]) for r in rows if r[2] == lang and r[1]), collections.Counter()), top) for lang in sorted({r[2] for r in rows if r[2]})}


def test_language_distances_by_hand(spark):
    rows = [(i, prose(i, 30 + i, lang), lang) for i, lang in enumerate(["aa", "zz"] * 6)] + [(50, "Éa é!! zu-zo ba1ba", None), (51, "12 34", None), (52, None, None), (53, "vu", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs, top=40)
    got = {r["doc_id"]: (r["lang_pred"], r["nearness"]) for r in langid.identify(docs, learned).collect()}
    profiles = profiles_of([r for r in rows if r[2]], 40)
    for i, text, _ in rows:
        lang, near = predicted(text, profiles, 40)
        assert got[i][0] == lang and got[i][1] == pytest.approx(near, abs=1e-12)


def test_several_texts_of_one_id_give_the_same_models(spark):
    r = random.Random(3)
    rows = [(i % 40, prose(i, 120) if i % 2 else "#$% " * r.randint(60, 90), i % 2) for i in range(120)]
    schema = "doc_id long, text string, quality int"
    found = []
    for order_ in (rows, rows[::-1]):
        df = spark.createDataFrame(order_, schema).repartition(3)
        labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
        docs = df.drop("quality")
        model = quality_mil.learn(docs, labels)
        judged = rules.judge(docs, labels).filter("NOT base_failed").agg(F.sum("anomaly")).first()[0]
        found.append((model.score([quality_mil.encode(rows[1][1])])[0], judged))
    assert found[0] == pytest.approx(found[1])


# the pipeline


def plain_chain(rows):
    """Rows (doc_id, text, lang, source) through the five stages; yields doc_id and the text that the packing gets, once a copy."""
    profiles = profiles_of(rows, langid.TOP)
    kept = []
    for r in rows:
        lang, near = predicted(r[1], profiles, langid.TOP)
        if lang != "und" and near >= langid.MIN_NEARNESS:
            kept.append(r)
    last = {}
    for r in kept:
        last[r[1]] = max(last.get(r[1], r[0]), r[0])
    kept = [r for r in kept if last[r[1]] == r[0]]
    sets = []
    for r in kept:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    label = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    smallest = {x: min(r[0] for r, y in zip(kept, label) if x == y) for x in label}
    kept = [r for r, x in zip(kept, label) if r[0] == smallest[x]]

    size = {r[0]: len(WORD.findall(r[1])) for r in kept}
    sources = sorted({r[3] for r in kept}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    of = {s: sum(size[r[0]] for r in kept if r[3] == s) for s in sources}
    total, full = sum(of.values()), set()
    while True:
        level = (total - sum(3 * of[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and 3 * of[s] < weight[s] * level}
        if not more:
            break
        full |= more
    for s in sources:
        budget = math.floor((3 * of[s] if s in full else weight[s] * level) + 0.5)
        epochs, rest = divmod(budget, of[s])
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: hashlib.sha256(f"mix-1:{r[0]}".encode()).hexdigest()):
            for _ in range(epochs):
                yield r[0], r[1]
            part = min(size[r[0]], rest)
            rest -= part
            if part:
                yield r[0], r[1] if part == size[r[0]] else r[1][: list(WORD.finditer(r[1]))[part - 1].end()]


def test_pipeline_is_the_chain_of_its_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [(i, prose(i, 40 + 13 * (i % 60), "aa" if i % 3 else "zz"), "aa" if i % 3 else "zz", [None, "web", "books", "news"][min(i % 7, 3)]) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2], "web") for i in range(5)]  # copies
    rows += [(200 + i, rows[10 + i][1] + " ba be ko", rows[10 + i][2], "books") for i in range(6)]  # near copies
    rows += [(300, None, None, None), (301, "", "aa", "web"), (302, "12 ## 34", None, "web"), (303, prose(5, 3000), None, None), (304, "ba", "aa", "news")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    expected = collections.Counter()
    for doc_id, text in plain_chain(rows):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        cut = len(ids) % 2048 if len(ids) > 2048 and len(ids) % 2048 and (out[(out.doc_id == doc_id) & (out.piece == 0)]["length"] < 2048).any() else 2048
        starts = [0, *range(cut, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            expected[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = collections.Counter((int(r.doc_id), int(r.piece), int(r.start), int(r.length), int(r.ids_crc32)) for r in out.itertuples())
    assert got == expected
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, None, None, None, None), (1, None, "aa", "s", 3)])):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect() == []
