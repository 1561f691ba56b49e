"""Matching by components, stability, intervals, skylines and hazard ratios against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from bimosaic.operators import archive, matching, statistics, structure

PAIRS = "task long, a long, b long, weight double"


def best_total(pairs):
    """The heaviest one-to-one matching by trying every subset of pairs."""
    out = 0.0
    for k in range(1, len(pairs) + 1):
        for some in itertools.combinations(pairs, k):
            if len({p[0] for p in some}) == len({p[1] for p in some}) == k:
                out = max(out, sum(p[2] for p in some))
    return out


def test_matching_by_components_is_the_best_of_the_whole(spark):
    r = np.random.default_rng(4)
    rows = []
    for task in range(4):
        for _ in range(9):
            rows.append((task, int(r.integers(6)), int(r.integers(6)), float(r.integers(0, 9))))
    rows = list({(t, a, b): (t, a, b, w) for t, a, b, w in rows}.values())
    got = {x["task"]: x["matched"] for x in matching.matched_weight(spark.createDataFrame(rows, PAIRS), "task").collect()}
    assert got == {t: best_total([x[1:] for x in rows if x[0] == t]) for t in {x[0] for x in rows}}
    pairs = matching.matching(spark.createDataFrame(rows, PAIRS), "task").collect()
    assert all(len({p[s] for p in pairs if p["task"] == t}) == sum(p["task"] == t for p in pairs) for t in range(4) for s in ("a", "b"))
    whole = spark.createDataFrame([x for x in rows if x[0] == 0], PAIRS)
    assert matching.matched_weight(whole).first()["matched"] == best_total([x[1:] for x in rows if x[0] == 0])
    assert matching.matched_weight(whole.limit(0)).first()["matched"] == 0


def test_components_of_long_chains_and_stars(spark):
    chain = [(int(a), int(b)) for a, b in zip(np.random.default_rng(1).permutation(200)[:-1], np.random.default_rng(1).permutation(200)[1:])]
    edges = chain + [(1000, 1000 + k) for k in range(1, 30)] + [(2000, 2001), (2000, 2001), (5, 5)]
    got = {x["node"]: x["component"] for x in matching.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(200)}, **{1000 + k: 1000 for k in range(30)}, 2000: 2000, 2001: 2000}


def test_stability_of_sets_and_of_members(spark):
    r = np.random.default_rng(6)
    sizes, scores = {1: (4, 3), 2: (4, 6), 3: (4, 2)}, []
    for right, (n, m) in sizes.items():
        scores += [(-1, right, a, b, float(r.integers(1, 10) / 10)) for a in range(n) for b in range(m) if r.random() < 0.5]
    frame = spark.createDataFrame(scores, "left long, right long, a long, b long, weight double")
    counts = spark.createDataFrame([(-1, k, n, m) for k, (n, m) in sizes.items()] + [(-1, 9, 4, 0)], "left long, right long, left_count long, right_count long")
    got = {x["right"]: x.asDict() for x in matching.repertoire_stability(frame, counts, (0.5, 0.8)).collect()}
    matched = {}
    for right, (n, m) in sizes.items():
        w = np.zeros((n, m))
        for _, k, a, b, v in scores:
            if k == right:
                w[a, b] = v
        total = max(sum(w[a, b] for a, b in zip(rows, cols)) for rows in itertools.permutations(range(n), min(n, m)) for cols in itertools.combinations(range(m), min(n, m)))
        found = [w[a, b] for a, b in structure.assignment(w)]
        assert sum(found) == pytest.approx(total)
        matched[right] = dict(structure.assignment(w)), w
        x = got[right]
        assert x["matched_count"] == min(n, m) and x["mean_matched_stability"] == pytest.approx(total / min(n, m))
        assert x["median_matched_stability"] == pytest.approx(np.median(found)) and x["coverage_at_0_5"] == pytest.approx(sum(v >= 0.5 for v in found) / max(n, m))
    assert (got[9]["matched_count"], got[9]["mean_matched_stability"], got[9]["coverage_at_0_8"]) == (0, 0, 0)
    out = matching.reference_stability(frame, spark.range(4), spark.createDataFrame([(k,) for k in sizes], "right long"), 0.5).collect()
    for x in out:
        v = [float(w[x["id"], p[x["id"]]]) if x["id"] in p else 0.0 for p, w in matched.values()]
        assert (x["comparison_count"], x["matched_count"]) == (3, sum(s >= 0.5 for s in v))
        assert (x["mean_matched_stability"], x["median_matched_stability"], x["minimum_matched_stability"], x["maximum_matched_stability"]) == pytest.approx((np.mean(v), np.median(v), min(v), max(v)))


def sets(seed, n):
    r = np.random.default_rng(seed)
    return {k: (set(r.choice(14, 6, replace=False).tolist()), set(r.choice(6, 3, replace=False).tolist())) for k in range(n)}


def error(a, b):
    """Complement of the clustering error of two lists of biclusters, copies included."""
    w = np.array([[len(x[0] & y[0]) * len(x[1] & y[1]) for y in b] for x in a], float)
    count = lambda s: pd.Series([c for x in s for c in itertools.product(*x)]).value_counts()
    p, q = count(a).align(count(b), fill_value=0)
    return sum(w[i, j] for i, j in structure.assignment(w)) / np.maximum(p, q).sum()


def test_intervals_match_numpy(spark):
    a, b = sets(1, 4), sets(2, 5)
    cells = lambda s: spark.createDataFrame([(k, i, j) for k, (rows, cols) in s.items() for i in rows for j in cols], "id long, row_index long, column_index int")
    shared = [(i, j, float(len(x[0] & y[0]) * len(x[1] & y[1]))) for i, x in a.items() for j, y in b.items()]
    got = matching.bootstrap_error(spark.createDataFrame(shared, "a long, b long, weight double"), cells(a), cells(b), draws=60, seed=5).first()
    values = []
    for d in range(60):
        p = np.random.default_rng([5, 2, d]).integers(0, 4, 4)
        q = np.random.default_rng([5, 3, d]).integers(0, 5, 5)
        values.append(error([a[k] for k in p], [b[k] for k in q]))
    assert tuple(got) == pytest.approx((error(list(a.values()), list(b.values())), *np.quantile(values, [0.025, 0.975])))

    r = np.random.default_rng(8)
    best = [(k * 3, float(r.random()), float(r.random())) for k in range(7)]
    got = matching.bootstrap_relevance(spark.createDataFrame(best, "id long, r double, c double"), draws=2000, seed=1).first()
    x = np.array([v[1:] for v in best])
    score = lambda v: math.sqrt(v[:, 0].mean() * v[:, 1].mean())
    draws = [score(x[np.random.default_rng([1, 0, d]).integers(0, 7, 7)]) for d in range(2000)]
    assert tuple(got) == pytest.approx((score(x), *np.quantile(draws, [0.025, 0.975])))


def test_bootstrap_of_means_matches_numpy(spark):
    values = np.random.default_rng(2).normal(size=12)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("one", 3.0)], "g string, v double")
    got = {x["g"]: (x["low"], x["high"]) for x in statistics.bootstrap_mean(df, "g", "v", seed=3).collect()}
    ordered = np.sort(values)
    means = ordered[np.random.default_rng(3).integers(0, 12, (2000, 12))].mean(1)
    assert got["g"] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975]))) and got["one"] == (3.0, 3.0)


@pytest.mark.parametrize("block", [20_000, 9])
def test_skylines_of_many_losses(spark, monkeypatch, block):
    monkeypatch.setattr(archive, "POINTS", block)
    r = np.random.default_rng(11)
    rows = [(i, int(r.integers(3)) if r.random() < 0.9 else None, *[float(r.integers(5)) if r.random() < 0.97 else None for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, cell long, a double, b double, c double, d double")
    inf = lambda v: math.inf if v is None else v
    for names in (["a"], ["a", "b", "c"], ["a", "b", "c", "d"]):
        got = {x["id"] for x in archive.pareto_front(df, *names).collect()}
        p = {x[0]: (x[1], [inf(v) for v in x[2 : 2 + len(names)]]) for x in rows}
        beaten = lambda i: any(p[j][0] == p[i][0] and all(u <= v for u, v in zip(p[j][1], p[i][1])) and p[j][1] != p[i][1] for j in p)
        assert got == {i for i in p if not beaten(i)}
    assert archive.pareto_front(df.limit(0), "a", "b", "c").collect() == []


def hazard(times, events, member):
    beta = 0.0
    for _ in range(50):
        score = information = 0.0
        w = np.exp(np.clip(beta * member, -40, 40))
        for t in sorted(set(times[events == 1])):
            risk, d = times >= t, ((times == t) & (events == 1))
            mean = (w[risk] * member[risk]).sum() / w[risk].sum()
            score += member[d].sum() - d.sum() * mean
            information += d.sum() * mean * (1 - mean)
        if information <= 1e-12:
            return 1.0
        beta += score / information
        if abs(score / information) < 1e-9:
            break
    return math.exp(max(-40, min(40, beta)))


def test_hazard_ratios_match_plain_newton(spark):
    r = np.random.default_rng(13)
    groups = {g: (r.integers(1, 12, 40), r.integers(0, 2, 40), r.integers(0, 2, 40)) for g in range(4)}
    groups[4] = (np.array([1, 2, 3, 10, 11, 12]), np.ones(6, int), np.array([1, 1, 1, 0, 0, 0]))  # separated
    groups[5] = (np.arange(1, 6), np.zeros(5, int), np.array([0, 1, 0, 1, 0]))  # no events
    groups[6] = (np.arange(1, 6), np.ones(5, int), np.ones(5, int))  # members only
    rows = [(g, int(t), int(e), int(m)) for g, v in groups.items() for t, e, m in zip(*v)]
    got = {x["g"]: x["hazard_ratio"] for x in statistics.cox_binary(spark.createDataFrame(rows, "g long, t long, e int, m int"), "t", "e", "m", "g").collect()}
    for g, v in groups.items():
        assert got[g] == pytest.approx(hazard(*v), rel=1e-6), g
    assert got[5] == got[6] == 1.0
