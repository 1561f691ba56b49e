"""Edge cases, brute-force comparisons, exact round trips and held-out accuracy of the corpus operators."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bimosaic.llm import chat, common, exact_dedup, langid, mixing, near_dedup, packing, pii, quality_mil, queries, rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long"
DIR = "/root/testdata/sf0.001"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def frame(spark, texts, sources=None, langs=None, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    n = len(texts)
    rows = [(ids[i] if ids else i, t, langs[i] if langs else None, sources[i] if sources else None, None, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA) if n else spark.createDataFrame([], SCHEMA)


ODD = [None, "", " \n\t", "one", "a b c d e f", "a b c d e f", words(1, 6000), "é ü 日本 <|endoftext|> x", words(2, 60), words(2, 60) + " more", None]


def collect(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# near duplicates


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(sets):
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


def edited(base: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in base.split())


def test_near_duplicates_match_brute_force(spark):
    texts = list(ODD)
    for k in range(12):
        base = words(100 + k, 150)
        texts += [base] + [edited(base, 7 * k + j, 0.004 * (j + 1)) for j in range(8)]
    group = words(999, 120)
    texts += [edited(group, 5000 + j, 0.01) for j in range(90)]  # more than a leaf holds
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    sets = brute_sets(texts)
    expected = brute_components(sets)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), expected[i], expected[i] == i) for i in range(len(texts))}


def test_near_duplicates_of_a_star(spark):
    base = [f"w{k}" for k in range(120)]
    texts = []
    for j in range(1200):
        copy, r = list(base), random.Random(j)
        for k in (r.randint(2, 38), r.randint(41, 77), r.randint(80, 116)):  # 0.77 to the base, mostly about 0.62 to one another
            copy[k] = f"x{j}-{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(base), " ".join(base[:70] + [f"y{k}" for k in range(50)])]
    expected = brute_components(brute_sets(texts))
    assert expected[1199] == expected[1200] == 0
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    lost = [i for i, c in got.items() if c != expected[i]]
    assert got[1200] == 0 and got[1201] == 1201 and len(lost) <= 6, lost  # the paths' own recall


def test_twins_of_one_template_are_found(spark):
    r, words_, texts = random.Random(1), 600, []
    for p in range(150):  # twins share 5 of the 13 words that each replaces: 0.763, and about 0.67 to all others
        common = r.sample(range(words_), 5)
        for side in "ab":
            t = [f"w{k}" for k in range(words_)]
            for k in common:
                t[k] = f"c{p}x{k}"
            for k in r.sample([k for k in range(words_) if k not in common], 8):
                t[k] = f"{side}{p}x{k}"
            texts.append(" ".join(t))
    expected = brute_components(brute_sets(texts))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert sum(got[i] == expected[i] for i in got) >= 0.99 * len(texts)


def test_near_duplicates_without_ids_and_with_two_texts_of_one_id(spark):
    one, other, lone = words(31, 60), words(32, 60), words(33, 60)
    rows = [(None, one), (None, lone), (8, one + " x"), (5, other), (5, one + " y"), (9, other + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(collect(near_dedup.near_duplicates(docs), "doc_id", "component_id", "kept"), key=str)
    assert got == sorted([(None, 5, False), (None, None, True), (8, 5, False), (5, 5, True), (5, 5, True), (9, 5, False)], key=str)
    assert sorted((str(r["doc_id"]) for r in near_dedup.keep_one(docs).collect())) == ["5", "5", "None", "None"]


def test_pairs_in_large_nodes_survive_branching(spark):
    r, n = np.random.default_rng(7), near_dedup.PATH_TOKENS
    hot = lambda: np.where(r.random((2000, n)) < 0.85, np.uint32(0), r.integers(1, 1 << 32, (2000, n), dtype=np.uint32))
    one, other = hot(), hot()
    other = np.where(r.random((2000, n)) < 0.75, one, r.integers(1, 1 << 32, (2000, n), dtype=np.uint32))  # pairs at 0.75
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(np.concatenate([one, other]))]
    reps = spark.createDataFrame(rows, "rep long, sig binary")
    nodes, over = near_dedup.leaves(reps, near_dedup.roots(reps), leaf=32)
    over = over.filter("open").select("grp", "rep")
    at: dict[int, set] = {}
    for df in (nodes, over):
        for node, rep in [] if df is None else df.collect():
            at.setdefault(rep, set()).add(node)
    assert over is not None
    assert sum(bool(at.get(i, set()) & at.get(i + 2000, set())) for i in range(2000)) >= 1990


def test_nodes_of_one_label_are_left_out(spark):
    r, n = np.random.default_rng(8), near_dedup.PATH_TOKENS
    tied, open_, both = (bytearray(r.integers(1, 1 << 32, n, dtype=np.uint32).tobytes()) for _ in range(3))
    rows = [(i, tied, 0) for i in range(50)] + [(i, open_, i) for i in range(50, 70)] + [(i, both, 70 + i % 2) for i in range(70, 120)]
    reps = spark.createDataFrame(rows, "rep long, sig binary, label long")
    at = near_dedup.roots(reps)
    assert sorted(r["n"] for r in near_dedup.large(at, leaf=16).collect()) == [50] * 16
    assert {(r["rep"] // 50 + r["rep"] // 70, r["n"], r["pairs"]) for r in near_dedup.mixed(at, True).collect()} == {(1, 20, 190), (2, 50, 625), (3, 50, 625)}
    nodes, crossed = near_dedup.leaves(reps, at, True, leaf=16)
    assert {r["rep"] for r in nodes.collect()} == set(range(50, 70))  # 0 to 49 are one component already
    assert {(r["rep"], r["open"]) for r in crossed.collect()} == {(i, False) for i in range(70, 120)}


def test_filter_grows_with_its_keys_and_loses_none(spark):
    rows, keys = spark.range(100_000).selectExpr("id", "id % 7 AS x"), spark.range(0, 100_000, 500)
    bits = common.filter_bits(200)
    assert bits == 1 << 16 and common.filter_bits(0) == 1 << 15 and common.filter_bits(1 << 40) == common.FILTER_BITS
    got = {r["id"] for r in common.maybe_among(rows, keys, "id", bits).collect()}
    assert got >= set(range(0, 100_000, 500)) and len(got) < 2000
    sent = common.with_maybe(rows, keys, "id", "hit", bits)
    assert sent.columns == ["id", "x", "hit"] and sent.count() == 100_000


def test_full_links_in_column_chunks():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 60, 90_000).astype(np.uint64))
    sets = [np.sort(r.choice(base, int(len(base) * 0.95), replace=False)) for _ in range(200)] + [np.unique(r.integers(0, 1 << 60, 90_000).astype(np.uint64))]
    assert sorted({y for x in near_dedup._full_links(sets) for y in x}) == list(range(200))


def test_a_chain_of_links_becomes_a_star():
    chain = [(k, k + 1) for k in range(10, 59)] + [(5, 3), (8, 5)]
    assert sorted(near_dedup._stars(chain[::-1])) == sorted([(10, k) for k in range(11, 60)] + [(3, 5), (3, 8)])
    assert near_dedup._stars([]) == []


def test_blocks_give_stars_so_labels_arrive_in_one_round(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[10 * k : 10 * k + 204]) for k in range(20)]  # each like the next ones only
    docs = frame(spark, texts)
    by_set = near_dedup.distinct_sets(near_dedup.sets_of(docs))
    links = near_dedup.confirmed_links(docs, by_set.select(F.lit(1).alias("block"), "rep"), by_set)
    reps = sorted(r["rep"] for r in by_set.collect())
    assert sorted((r["a"], r["b"]) for r in links.collect()) == [(reps[0], x) for x in reps[1:]]
    written = []
    real = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name, *a, **k: written.append(name) or real(df, name, *a, **k))
    assert {r["component"] for r in near_dedup.components(links).collect()} == {reps[0]}
    assert written == ["components-links"] + ["components"] * 3  # first labels, and one round that changes nothing


def test_only_tables_with_text_are_compressed(spark):
    before = spark.conf.get(common.CODEC)
    plain = common.materialize(spark.range(10).select("id", F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest")), "plain")
    text = common.materialize(spark.range(10).select(F.col("id").cast("string").alias("text")), "text")
    assert sorted(r["id"] for r in plain.collect()) == list(range(10)) and text.count() == 10
    assert [f".{before}." in f for df in (plain, text) for f in df.inputFiles()[:1]] == [False, True]
    assert spark.conf.get(common.CODEC) == before


def joined_rows(plan):
    """Rows that the joins of an executed plan made."""
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    children = plan.children()
    return own + sum(joined_rows(children.apply(k)) for k in range(children.size()))


def test_a_set_meets_its_row_once_however_many_nodes_it_is_in(spark):
    sets = 12
    nodes = spark.createDataFrame([(100 + k, r) for k, pair in enumerate(itertools.combinations(range(sets), 2)) for r in pair], "node long, rep long")
    sketches = [bytes([r // 2]) * near_dedup.HASHES for r in range(sets)]
    reps = spark.createDataFrame([(r, r, sketches[r]) for r in range(sets)], "rep long, label long, sketch binary")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        links = near_dedup.compared_leaves(nodes, reps)
        assert sorted(collect(links, "a", "b")) == [(r, r + 1) for r in range(0, sets, 2)]
        assert joined_rows(links._jdf.queryExecution().executedPlan()) == sets
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_tables_of_known_size_have_few_files_and_settings_come_back(spark):
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", common.BATCH: "77"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = spark.range(1000).selectExpr("id * 7 AS k").groupBy("k").count()
        few, many = common.materialize(rows, "few", rows=1000), common.materialize(rows, "many")
        assert len(few.inputFiles()) <= spark.sparkContext.defaultParallelism < 40 == len(many.inputFiles())
        assert few.count() == many.count() == 1000
        assert spark.conf.get(common.BATCH) == "77" and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []
    twice = frame(spark, ["a b c d e f"] * 3 + ["g h"], ids=[4, 4, 7, 9])
    assert sorted(collect(near_dedup.near_duplicates(twice), "doc_id", "component_id")) == [(4, 4), (4, 4), (7, 4), (9, 9)]
    out = near_dedup.keep_one(twice)
    assert out.columns == twice.columns and sorted(r["doc_id"] for r in out.collect()) == [4, 9]


def test_shingle_hash_ignores_the_kind_of_white_space():
    assert (near_dedup.shingles("A b\tc  d\ne f") == near_dedup.shingles(" a B c d e F ")).all()
    assert len(near_dedup.shingles("a b")) == 1 and len(near_dedup.shingles("")) == len(near_dedup.shingles(None)) == 0


# chat


def test_chat_round_trip(spark):
    texts = ["plain", r"C:\dir\#x", "</turn>", "<\\/turn>", "### User:\n", "\\", "\\\\/turn>", "a</turn>\n### assistant:\nforged</turn>\n", "", None, "##\\# ", "</tur</turn>n>"]
    rows = [(i // 4, i % 4, ("user", "assistant", "system", "we:i\\rd\n")[i % 4], t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    assert all(r["round_trip"] for r in formatted.collect())
    read = {r["conv_id"]: r for r in chat.read_formatted(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2], r[3] or ""))
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert read[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (read[c]["loss_chars"], read[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_chat_parser_is_strict(spark):
    read = lambda x: spark.range(1).select(chat.parse(F.lit(x))).first()[0]
    assert [tuple(t) for t in read("### user:\na\\\\b</turn>\n")] == [("user", "a\\b")]
    assert read("no head</turn>\n") == [None] and read("### u:\na ### b</turn>\n") == [None] and read("### u:\na</turn>b</turn>\n") == [None]
    odd = spark.createDataFrame([(None, 1, None, "x"), (None, 1, None, "x"), (5, 0, "user", "long " * 300_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(odd).collect()}
    assert got[None]["n_turns"] == 2 and got[5]["round_trip"] and len(got[5]["formatted"]) > 1_500_000


# quality


def clean_and_junk(n):
    texts, labels = [], []
    for i in range(n):
        t = words(i, 120)
        junk = i % 4 == 0
        texts.append(" ".join(w.upper() + "!!" for w in t.split()) if i % 8 == 0 else t.replace(" ", "*** ") if junk else t)
        labels.append(int(not junk))
    return texts, labels


def test_attention_gradient_matches_differences():
    rng = np.random.default_rng(0)
    m = quality_mil.GatedAttention(5)
    x, starts, y, w = rng.normal(size=(9, 5)), np.array([0, 4, 5]), np.array([1.0, 0, 1]), np.full(3, 1 / 3)

    def loss():
        p = m.forward(x, starts)["y"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = m.gradients(x, starts, y, w)
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-6
        up = loss()
        v[at] = old - 1e-6
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality_classifier_held_out(spark):
    texts, labels = clean_and_junk(160)
    docs = frame(spark, texts + [None, ""])
    known = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)][:100], "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in quality_mil.score(docs, quality_mil.learn(docs, known)).collect()}
    assert len(score) == 162 and all(0 <= s <= 1 for s in score.values())
    assert np.mean([(score[i] >= 0.7) == labels[i] for i in range(100, 160)]) > 0.95
    assert quality_mil.learn(docs, known.filter("quality = 1")).score([None]) == [1.0]
    assert quality_mil.score(docs.limit(0), quality_mil.Constant(0.5)).collect() == []


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})


def test_rule_statistics_match_brute_force():
    r = random.Random(3)
    for n in [0, 1, 3, 4, 50, 400]:
        text = "".join(r.choice(["a", "b", "c*", "d|"]) + r.choice([" ", "  ", "\n", "\t", "\n\n"]) for _ in range(n))
        got = dict(zip(rules.NAMES[1:], rules.statistics(text)))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (len(w), sum(map(len, w)), brute_repeats(text))
        assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert got["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
    assert rules.statistics(None)[0] == 0


def test_path_lengths_match_a_walk_by_hand():
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 3))
    forest = rules.Forest(x, x.min(0), x.max(0), trees=7, sample=32, depth=5)
    by_hand = []
    for row in np.concatenate([x[:20], x[:1] + 50]):
        total = 0.0
        for t in forest.trees:
            k = 0
            while t[k][0] >= 0:
                k = int(t[k][3] if row[int(t[k][0])] >= t[k][1] else t[k][2])
            total += t[k][4]
        by_hand.append(2 ** (-total / 7 / forest.unit))
    assert forest.score(np.concatenate([x[:20], x[:1] + 50])) == pytest.approx(by_hand)
    assert by_hand[-1] > np.mean(by_hand[:-1])


def test_rules_keep_clean_and_drop_junk(spark):
    texts, labels = clean_and_junk(200)
    docs = frame(spark, texts + ["short", None])
    known = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)][:120], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in rules.judge(docs, known).collect()}
    assert out[200]["base_failed"] and not out[201]["kept"]
    assert np.mean([out[i]["kept"] == bool(labels[i]) for i in range(120, 200)]) > 0.95
    assert all(r["kept"] != r["base_failed"] for r in rules.judge(docs, known.limit(0)).collect())


def test_rules_fit_counts_every_labelled_row(spark):
    r = np.random.default_rng(6)
    n = 9000
    quality = (r.random(n) < 0.8).astype(int)
    words = r.integers(60, 900, n)
    symbols = np.where(quality == 1, r.integers(0, 20, n), r.integers(0, 500, n))
    cells = [range(n), words, words * r.integers(3, 9, n), symbols, words * 0, r.integers(0, 25, n), words * 0 + 1, r.integers(0, 40, n), words * 3, r.integers(0, 9, n)]
    stats = spark.createDataFrame([tuple(map(int, x)) for x in zip(*cells, strict=True)], rules.STATS)
    labels = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quality)], "doc_id long, quality int")
    forest, threshold = rules.fit(stats, labels)
    x = rules.features({c: np.array(v, float) for c, v in zip(rules.NAMES, cells, strict=True)})
    halves = {i: h for i, h in spark.range(n).selectExpr("id", "pmod(xxhash64(id, 23), 2)").collect()}
    grow = x[[i for i in range(n) if quality[i] and halves[i] == 0]]
    for t in forest.trees[::12]:  # every row that grows the forest is in one leaf of each tree
        held = {}
        for row in grow:
            k = d = 0
            while t[k][0] >= 0:
                k, d = int(t[k][3] if row[int(t[k][0])] >= t[k][1] else t[k][2]), d + 1
            held[k, d] = held.get((k, d), 0) + 1
        assert all(t[k][4] == pytest.approx(d + float(rules._mean_path(c))) for (k, d), c in held.items())
    rest = [i for i in range(n) if not quality[i] or halves[i]]
    score, good = forest.score(x[rest]), quality[rest] == 1
    gain = {}
    for s in np.unique(score):
        lost, caught = int((score[good] > s).sum()), int((score[~good] > s).sum())
        if lost <= rules.MAX_CLEAN_LOSS * good.sum():
            gain[s] = (caught * int(good.sum()) - lost * int((~good).sum()), s)
    best = max(gain, key=gain.get)
    assert threshold == pytest.approx((best + score[score > best].min()) / 2, abs=1e-12)


# packing


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(queries.tokenizer_path())
    r = random.Random(1)
    odd = ["", " ", "\n", "a\n\nb", "it's 12,5 a.b x²y", "<|endoftext|>x", "日本語 テスト。ok", "\x1cab cd", "a b\x85c"]
    odd += ["".join(r.choice(" \n.,'abXYéß12²*!#_-\t 日ª") for _ in range(r.randint(1, 40))) for _ in range(2000)]
    assert [t for t in odd if e.encode(t) != e.whole(t)] == []


def test_recurring_words_stay_remembered(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 40)
    e = packing.Encoder(queries.tokenizer_path())
    coded, real = [], e.letters_only
    monkeypatch.setattr(e, "letters_only", lambda word: coded.append(word) or real(word))
    letters = "abcdefghij"
    text = "a " + " ".join(f"again, {x}{y}{z}" for x in letters for y in letters for z in letters)
    assert e.encode(text) == e.whole(text)
    assert coded.count(" again") == 1  # 1000 other words came between
    assert len(e.inner) + len(e.inner.older) <= 40


def test_plan_places_every_piece_once():
    r = random.Random(2)
    counts = {r.randint(1, 100): r.randint(1, 50) for _ in range(40)} | {100: 3}
    used: dict[int, list[tuple[int, int]]] = {}
    placed = {k: 0 for k in counts}
    for length, rank, n, first, each, offset in packing.plan(counts, 100):
        assert rank == placed[length]
        placed[length] += n
        for i in range(n):
            used.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert placed == counts
    for parts in used.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 100
    free: list[int] = []  # best fit of one piece after another
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = min((i for i, x in enumerate(free) if x >= length), key=lambda i: free[i], default=None)
        if at is None:
            free.append(100 - length)
        else:
            free[at] -= length
    assert len(used) == len(free)


def test_packing(spark):
    docs = frame(spark, ODD)
    out = packing.pack(docs, queries.tokenizer_path()).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    for i, text in enumerate(ODD):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = out[out.doc_id == i].sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"] <= 2048).all() and (own["length"].iloc[1:] == 2048).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum().shift(fill_value=0)).all() and own["length"].sum() <= 2048
    whole = packing.packed_sequences(docs, queries.tokenizer_path())
    assert whole.agg(F.sum("length")).first()[0] == out["length"].sum() and whole.filter("octet_length(ids) != 4 * length").isEmpty()
    assert packing.pack(frame(spark, []), queries.tokenizer_path()).collect() == []


# exact dedup


def test_exact_dedup(spark):
    docs = frame(spark, ["a", "a", None, "", "A", "a"], ids=[3, 9, 1, 2, 5, 9])
    out = exact_dedup.exact_groups(docs)
    assert sorted(collect(out, "doc_id", "keep_id", "group_size")) == [(1, 2, 2), (2, 2, 2), (3, 9, 3), (5, 5, 1), (9, 9, 3), (9, 9, 3)]
    assert sum(r["kept"] for r in out.collect()) == 3
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 9]
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []


def test_dedup_state_goes_on_from_its_checkpoint(spark, tmp_path):
    for step, ids in enumerate(([1, 2], [3])):
        exact_dedup.digest_log(frame(spark, ["same"] * len(ids), ids=ids)).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema("row_no long, doc_id long, digest string, n_bytes long, locator string").parquet(str(tmp_path / "log"))
        exact_dedup.dedup_stream(spark, stream, str(tmp_path / "state"))
        assert collect(exact_dedup.read_state(spark, str(tmp_path / "state")), "keep_id", "group_size") == [(2, 2), (3, 3)][step : step + 1]


def test_state_has_the_parts_it_needs_and_updates_equal_it(spark, tmp_path, monkeypatch):
    texts = [random.Random(i % 37).choice("abcdefg") * (i % 23) for i in range(200)]
    docs, parts = frame(spark, texts).repartition(6), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        for name, size in (("one", 64 << 30), ("several", 1)):
            monkeypatch.setattr(exact_dedup, "scratch", lambda _, x, name=name: str(tmp_path / name / x))
            got = collect(exact_dedup.exact_groups(docs, max_bytes_per_trigger=size), "doc_id", "keep_id", "group_size")
            assert sorted(got) == [(i, max(j for j, u in enumerate(texts) if u == t), texts.count(t)) for i, t in enumerate(texts)]
            at = tmp_path / name
            assert len([x for x in (at / "dedup-state/state/0").iterdir() if x.name.isdigit()]) == spark.sparkContext.defaultParallelism < 24
            batches = len(list((at / "dedup-updates").glob("batch=[0-9]*")))
            assert (batches > 1) == (name == "several")
            state, updates = exact_dedup.read_state(spark, str(at / "dedup-state")), exact_dedup.read_updates(spark, str(at / "dedup-updates"), batches)
            assert sorted(map(tuple, state.collect())) == sorted(map(tuple, updates.select(state.columns).collect()))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
        assert [exact_dedup.stores(spark, n) for n in (0, 900_000, 10**9)] == [4, 18, 24]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_equal_digests_with_other_bytes_are_told_apart(spark):
    texts, ids = ["a", "b", "a", "c", "d", None, "a"], [3, 8, 5, 1, 2, 9, 5]
    weak = lambda c: F.when(c.isin("a", "b", ""), F.lit("same")).otherwise(F.sha2(c, 256))
    docs = frame(spark, texts, ids=ids)
    assert collect(exact_dedup.unequal_digests(docs, spark.createDataFrame([("same",)], "digest string"), weak), "digest") == [("same",)]
    out = exact_dedup.exact_groups(docs, digest=weak)
    assert sorted(collect(out, "doc_id", "keep_id", "group_size")) == [(1, 1, 1), (2, 2, 1), (3, 5, 3), (5, 5, 3), (5, 5, 3), (8, 8, 1), (9, 9, 1)]
    assert sum(r["kept"] for r in out.collect()) == 5


# mixing


def test_mixing_meets_targets_to_the_word(spark):
    r = random.Random(5)
    texts = [" ".join("w" for _ in range(r.randint(0, 40))) for _ in range(300)] + [None]
    sources = [r.choice(["a", "b", "b", "b", "c", "c", None]) for _ in texts]
    docs = frame(spark, texts, sources)
    out = mixing.mixture(docs).toPandas()
    out["source"] = out["source"].fillna("~")
    for _, own in out.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 1
    assert (out["taken"] <= 3 * out["size"]).all()
    assert out.groupby("source")["target"].first().sum() == pytest.approx(out["size"].sum())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.withColumn("n", mixing.word_count()).groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 0").toPandas().set_index("doc_id")["n"]
    assert got.to_dict() == {int(k): int(v) for k, v in out.set_index("doc_id")["taken"].items() if v > 0}
    assert mixing.mixture(frame(spark, [])).collect() == []
    lone = mixing.mixture(frame(spark, ["", None], ["a", "b"])).toPandas()
    assert lone["taken"].sum() == 0 and len(lone) == 2


# personal data


PRIVATE = ["4012888888881881", "4111 1111 1111 1111", "+1 (323) 555-9830", "233.171.252.9", "anna.b50@mail6.example.com", "aebccd4559894937c75946a5f6a3ed5b13ef9ee9", "123-45-6789", "1999-12-31", "31/12/1999"]


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms_keep_format_and_links(spark):
    docs = frame(spark, [f"see {v}, or {v} now" for v in PRIVATE] + ["call " + PRIVATE[2], None, "", "no data 12 of 1999-13-45 at 300.1.1.1, 4012888888881882 or 900-12-3456"])
    out = {r["doc_id"]: r for r in pii.pseudonymize(docs, "secret").collect()}
    n = len(PRIVATE)
    for i, v in enumerate(PRIVATE):
        a, b = re.fullmatch(r"see (.*), or (.*) now", out[i]["text"]).groups()
        assert a == b != v and v not in out[i]["text"] and out[i]["pii_found"] == 2
        assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", a)) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", v)) or i in (3, 5)
        if i < 2:
            assert luhn(a) % 10 == luhn(v) % 10 == 0
    assert out[n]["text"][5:] == re.fullmatch(r"see (.*), or .* now", out[2]["text"]).group(1)
    assert out[n + 1]["text"] is None and out[n + 2]["text"] == "" and out[n + 3]["text"] == docs.collect()[n + 3]["text"] and out[n + 3]["pii_found"] == 0
    pd.to_datetime(re.search("see (.*), or", out[7]["text"]).group(1), format="%Y-%m-%d")


def test_permutations_are_one_to_one(spark):
    df = spark.range(3000).withColumn("s", F.lpad(F.col("id").cast("string"), 4, "0"))
    df = df.select(pii.permute_text(F.col("s"), "k", "t", (pii.DIGITS,)).alias("a"), pii.permute_number(F.col("id"), "k", "n", 60).alias("b"), pii._date(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), "k").alias("c"))
    assert df.agg(F.count_distinct("a"), F.count_distinct("b"), F.count_distinct("c")).first()[:] == (3000, 3000, 3000)


def feistel(value: str, key: str, kind: str, alphabets) -> str:
    """The permutation, digit by digit."""
    a, b = value[: len(value) // 2], value[len(value) // 2 :]

    def add(text, turn, other):
        digest = hashlib.sha256(f"{key}|{kind}|{turn}|{other}".encode()).digest()
        out = ""
        for i, c in enumerate(text):
            own = next((x for x in alphabets if c in x), None)
            out += own[(own.index(c) + digest[i % 32]) % len(own)] if own else c
        return out

    for turn in range(pii.ROUNDS):
        a, b = (add(a, turn, b), b) if turn % 2 == 0 else (a, add(b, turn, a))
    return a + b


def test_pseudonyms_match_a_plain_feistel_network(spark):
    values = [("555-0123-99", "phone", (pii.DIGITS,)), ("deadbeef" * 4, "key", (pii.HEX,)), ("Ann.b+7", "email", (pii.DIGITS, pii.LOWER, pii.UPPER)), ("7", "x", (pii.DIGITS,))]
    for v, kind, alphabets in values:
        got = spark.range(1).select(pii.permute_text(F.lit(v), "k2", kind, alphabets)).first()[0]
        assert got == feistel(v, "k2", kind, alphabets)
    body = feistel("411111111111111", "k2", "number", (pii.DIGITS,))
    got = spark.range(1).select(pii.pseudonym(F.lit("4111 1111 1111 1111"), "k2")).first()[0]
    assert got.replace(" ", "")[:15] == body and luhn(got) % 10 == 0 and [len(x) for x in got.split()] == [4] * 4
    assert pii.pseudonymize(frame(spark, []), "k").collect() == []


# language


def test_language_identification(spark):
    speak = {"en": "the quick brown fox and the lazy dog went to the river with this", "de": "der schnelle braune fuchs und die faule katze gehen zum fluss mit den", "fr": "le renard brun et la chatte paresseuse vont dans la rivière avec les"}
    r = random.Random(1)
    rows = [(lang, " ".join(r.choice(s.split()) for _ in range(40))) for lang, s in speak.items() for _ in range(12)]
    docs = frame(spark, [t for _, t in rows] + [None, "", "12 !!"], langs=[lang for lang, _ in rows] + [None] * 3)
    p = langid.learn(docs.filter("doc_id % 2 = 0"))
    out = {x["doc_id"]: x for x in langid.identify(docs, p).collect()}
    assert all(out[i]["lang_pred"] == rows[i][0] and 0 < out[i]["score"] <= 1 for i in range(36))
    assert [out[i]["lang_pred"] for i in (36, 37, 38)] == ["und"] * 3
    kept = langid.keep_known(docs, p)
    assert kept.columns == docs.columns and kept.count() == 36
    assert langid.identify(docs, langid.learn(docs.limit(0))).filter("lang_pred != 'und'").isEmpty()
    assert langid.identify(frame(spark, []), p).collect() == []


# sharding


def test_sharding_splits_only_what_is_too_large(spark):
    texts = [words(i, i % 50) for i in range(400)] + ["x" * 5000, None]
    ids = list(range(402))
    out = sharding.shards(frame(spark, texts, ids=ids), 4000).toPandas()
    sizes = out.groupby("shard")["n_bytes"].agg(["sum", "size"])
    assert ((sizes["sum"] <= 4000) | (sizes["size"] == 1)).all() and len(out) == 402
    names = sorted(sizes.index)
    assert not any(b.startswith(a) for a, b in itertools.permutations(names, 2))
    for s in names:  # the parent bucket was too large
        assert not s or sizes[[x.startswith(s[:-1]) for x in sizes.index]]["sum"].sum() > 4000
    same = sharding.shards(frame(spark, ["y" * 1000] * 20, ids=[7] * 20), 4000).toPandas()
    assert len(same) == 20 and (same.groupby("shard")["n_bytes"].sum() <= 4000).all()
    assert sharding.shards(frame(spark, []), 4000).collect() == []


# all queries and the pipeline


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline_and_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR).toPandas()
    assert set(out["doc_id"]) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DIR)
        key = sorted(df.columns)
        expected = c.sql(f"SELECT {', '.join(key)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, df.select(key).collect()))) == sorted(map(str, expected)), name
