"""Joint seeds: planted blocks are found, rankings and scores by plain NumPy, swaps against every choice of rows."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bimosaic.operators import joint_seeds, prepare

WANTED = "candidate long, n_rows long, n_columns long"


def planted(seed, product):
    """60 x 12, a block of rows 0-19 and columns 0-5, with holes."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(60, 12)) * 5
    a, b = r.normal(size=20) * 3, r.normal(size=6) * 2 + 4
    x[:20, :6] = (np.outer(a, b) if product else a[:, None] + b) + r.normal(size=(20, 6)) * 1e-3
    x[r.random(x.shape) < 0.04] = np.nan
    return x


def cells_of(spark, x):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "row_index long, column_index int, num double")


def scales(x):
    p = np.nanpercentile(x, [5, 50, 95], axis=0)
    return np.where(p[2] - p[0] > 1e-12, p[2] - p[0], np.maximum(np.abs(p[1]), 1))


@pytest.mark.parametrize("pattern", ["additive", "multiplicative"])
def test_pairs_rankings_and_scores_by_numpy(spark, pattern):
    product = pattern == "multiplicative"
    x = planted(1, product)
    x[3, :] = 0.0
    cells, seen = cells_of(spark, x), np.isfinite(x)
    stats = prepare.column_stats(cells)
    wanted = spark.createDataFrame([(0, 10, 4)], WANTED)
    strong = sorted(range(60), key=lambda i: (-seen[i].sum(), i))[:24]
    usable = {(a, b): int((seen[a] & seen[b] & ((np.abs(x[a]) > 1e-12) | (not product))).sum()) for a, b in itertools.combinations(strong, 2)}
    got = joint_seeds.row_pairs(cells, wanted, pattern).orderBy("place").collect()
    counts = [usable[r["first"], r["second"]] for r in got]
    assert len(got) == 32 and counts == sorted((v for v in usable.values() if v >= 4), reverse=True)[:32]

    pairs = spark.createDataFrame([(0, 0, 1, 4, 10), (1, 30, 31, 4, 10)], "candidate long, first long, second long, n_columns long, n_rows long")
    ranked = joint_seeds.relation_ranking(cells, pairs, stats, pattern, pool=99).collect()
    s = scales(x)
    for c, a, b in ((0, 0, 1), (1, 30, 31)):
        with np.errstate(all="ignore"):
            rel = x[b] / x[a] if product else x[b] - x[a]
        off = np.abs(rel - np.nanmedian(rel)) / (1 if product else s)
        own = {r["column_index"]: r for r in ranked if r["candidate"] == c}
        assert {j: pytest.approx(off[j]) for j in own} == {j: r["off"] for j, r in own.items()} and set(own) == set(np.flatnonzero(np.isfinite(off)).tolist())
        assert [j for j, r in sorted(own.items(), key=lambda v: v[1]["rank"])] == sorted(own, key=lambda j: (round(off[j], 12), j))

    columns, anchor = [0, 2, 3, 5, 7], 1
    got = joint_seeds.row_scores(cells, spark.createDataFrame([(0, j) for j in columns], "candidate long, column_index int"), spark.createDataFrame([(0, anchor)], "candidate long, row_index long"), stats, pattern).collect()
    y, sc = x[:, columns], s[columns]
    p = y[anchor] if product else y[anchor] - np.nanmedian(y[anchor])
    for r in got:
        row = y[r["row_index"]]
        with np.errstate(all="ignore"):
            v = np.where(np.isfinite(p) & (np.abs(p) > 1e-12), row / p, np.nan) if product else row
            d = np.abs(v - np.nanmedian(v)) if product else np.abs(v - np.nanmedian(v) - p) / sc
        if np.isfinite(d).sum() >= max(2, math.ceil(len(columns) * 0.8)):
            assert r["score"] == pytest.approx(np.nanmedian(d), abs=1e-12)
        else:
            assert r["score"] is None
        assert r["mask"] == sum(1 << k for k, w in enumerate(row) if np.isfinite(w))


@pytest.mark.parametrize("pattern", ["additive", "multiplicative"])
def test_planted_blocks_are_seeded(spark, pattern):
    hits = 0
    for seed in range(2):
        x = planted(10 + seed, pattern == "multiplicative")
        order = np.random.default_rng(seed).permutation(60)
        x[20:, ::3] = np.where(np.random.default_rng(seed).random((40, 4)) < 0.5, np.nan, x[20:, ::3])  # the block is best filled
        x = x[order]
        cells = cells_of(spark, x)
        wanted = spark.createDataFrame([(k, 8, 4) for k in range(6)], WANTED)
        rows, columns = joint_seeds.joint_seeds(cells, wanted, prepare.column_stats(cells), pattern, seed=f"s{seed}")
        r, c = {}, {}
        for v in rows.collect():
            r.setdefault(v["candidate"], set()).add(int(order[v["row_index"]]))
        for v in columns.collect():
            c.setdefault(v["candidate"], set()).add(v["column_index"])
        assert set(r) == set(c) and all(len(v) == 8 for v in r.values()) and all(len(v) == 4 for v in c.values())
        for k in r:
            at = np.flatnonzero(np.isin(order, list(r[k])))
            assert (np.isfinite(x[np.ix_(at, sorted(c[k]))]).sum(0) >= 7).all()
            hits += r[k] <= set(range(20)) and c[k] <= set(range(6))
    assert hits >= 3


def test_swaps_support_columns_whenever_greedy_swaps_can():
    r = np.random.default_rng(5)
    served = 0
    for _ in range(200):
        rows, scores = np.arange(9), r.random(9).round(1)
        held = r.random((9, 3)) < 0.6
        got = joint_seeds.swapped(rows, scores, held, 5, 4)
        best = sorted(range(9), key=lambda i: (scores[i], i))
        possible = any(set(best[:2]) <= set(s) and (held[list(s)].sum(0) >= 4).all() for s in itertools.combinations(range(9), 5))
        if got is not None:
            served += 1
            assert len(got) == 5 and set(best[:2]) <= set(got.tolist()) and (held[got].sum(0) >= 4).all() and possible
            if (held[best[:5]].sum(0) >= 4).all():
                assert sorted(got.tolist()) == sorted(best[:5])
    assert served >= 20
    assert joint_seeds.swapped(np.arange(3), np.zeros(3), np.ones((3, 2), bool), 4, 2) is None


def test_seeds_of_nothing(spark):
    cells = cells_of(spark, np.full((5, 3), np.nan))
    rows, columns = joint_seeds.joint_seeds(cells, spark.createDataFrame([(0, 3, 2)], WANTED), prepare.column_stats(cells), "additive")
    assert rows.collect() == columns.collect() == []
