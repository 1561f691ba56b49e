"""Hand-computed values for fits, contrast, preparation, archive, overlap and statistics."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bimosaic.functions import pvalues
from bimosaic.operators import archive, contrast, evaluate, fit, joint, prepare, selection, statistics, structure

CELLS = "row_index long, column_index int, num double, code int"


def numeric(spark, *columns):
    return spark.createDataFrame([(r, c, None if v is None else float(v), None) for c, col in enumerate(columns) for r, v in enumerate(col)], CELLS)


def codes(spark, *columns):
    return spark.createDataFrame([(r, c, None, v) for c, col in enumerate(columns) for r, v in enumerate(col)], CELLS)


def candidate(spark, rows, columns):
    return spark.createDataFrame([(0, r) for r in rows], "candidate long, row_index long"), spark.createDataFrame([(0, c) for c in columns], "candidate long, column_index int")


def test_profile_and_scaling(spark):
    cells = numeric(spark, [0.0, None, 5.0, 10.0], [3.0, 3.0, 3.0, None], [None] * 4)
    s = {r["column_index"]: r for r in prepare.column_stats(cells).collect()}
    assert (s[0]["n"], s[0]["p05"], s[0]["median"], s[0]["p95"], s[0]["robust_range"]) == (3, 0.5, 5.0, 9.5, 9.0)
    assert s[1]["zero_scale"] and s[2]["n"] == 0 and s[2]["median"] is None and not s[2]["zero_scale"]
    out = {(r["row_index"], r["column_index"]): r["num"] for r in prepare.robust_scale(cells, prepare.column_stats(cells)).collect()}
    assert out[0, 0] == pytest.approx(-5 / 9) and out[1, 0] is None and out[3, 0] == pytest.approx(5 / 9) and out[0, 1] == 0.0
    rare = numeric(spark, [0.0] * 20 + [10.0])
    assert [r["num"] for r in prepare.robust_scale(rare, prepare.column_stats(rare)).orderBy("row_index").collect()] == [0.0] * 20 + [1.0]


def test_imputation_ties_go_to_the_lowest_code(spark):
    out = prepare.impute_median_mode(codes(spark, [1, 0, None, 1, 0])).filter("row_index = 2").first()
    assert (out["code"], out["observed"], out["available"]) == (0, False, True)


def test_contrast_of_blocks_matches_all_pairs(spark):
    """A constant block and an additive one, against every pair of a residual inside and one outside."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(30, 4)).round(2)
    members = sorted(rng.choice(30, 11, replace=False).tolist())
    x[members, 0] = 3 + rng.normal(size=11).round(2) / 50
    effect = rng.normal(size=30).round(2) * 2
    x[members, 1:] = effect[members, None] + np.array([1.0, -2.0, 0.5])
    cells = numeric(spark, *x.T.tolist())
    outside = [i for i in range(30) if i not in members]
    chance = lambda r: np.mean([1.0 if r[a] < r[b] - 1e-12 else 0.5 if abs(r[a] - r[b]) <= 1e-12 else 0.0 for a in members for b in outside])
    rows, columns = candidate(spark, members, [0])
    fits = fit.constant_fit_numeric(fit.submatrix(cells, rows, columns), prepare.column_stats(cells))
    got = contrast.constant_contrast_numeric(cells, rows, columns, fits).first()["contrast"]
    assert got == pytest.approx(chance(np.abs(x[:, 0] - np.median(x[members, 0]))), abs=1e-12) and got > 0.9
    rows, columns = candidate(spark, members, [1, 2, 3])
    found = joint.joint_fit(fit.submatrix(cells, rows, columns), prepare.column_stats(cells), "additive").orderBy("column_index").collect()
    assert [r["error"] for r in found] == pytest.approx([0, 0, 0], abs=1e-9)
    beta = np.array([r["beta"] for r in found])
    alpha = np.median(x[:, 1:] - beta, axis=1)
    b = spark.createDataFrame([(0, r["column_index"], r["beta"]) for r in found], "candidate long, column_index int, beta double")
    out = contrast.additive_contrast(cells, rows, columns, fit.additive_row_effects(cells, columns, b), b).orderBy("column_index").collect()
    assert [r["contrast"] for r in out] == pytest.approx([chance(np.abs(x[:, j + 1] - alpha - beta[j])) for j in range(3)], abs=1e-9)


def test_categorical_separation_matches_brute_force(spark):
    rng = np.random.default_rng(12)
    for size, kinds in ((9, 2), (14, 3), (20, 5)):
        labels = rng.integers(0, kinds, size).tolist()
        inside = sorted(rng.choice(size, 4, replace=False).tolist())
        cells = codes(spark, labels)
        rows, columns = candidate(spark, inside, [0])
        fits = fit.constant_fit_discrete(fit.submatrix(cells, rows, columns), prepare.frequencies(cells))
        own = [labels[i] for i in inside]
        mode = min(own, key=lambda x: (-own.count(x), x))
        rest = [x for i, x in enumerate(labels) if i not in inside]
        p, q = own.count(mode) / len(own), rest.count(mode) / len(rest)
        room = 1 - q if p >= q else q  # to the largest possible change on that side
        expected = (1 + (p - q) / room) / 2 if room else 0.5
        got = contrast.constant_contrast_discrete(cells, rows, columns, fits).collect()
        assert [r["contrast"] for r in got] == pytest.approx([expected])


def test_mixed_coherence(spark):
    n, c = numeric(spark, [0.0, 0, 10, 10]), codes(spark, [0, 1, 2, 2])
    rows, columns = candidate(spark, range(4), [0])
    a = fit.constant_fit_numeric(fit.submatrix(n, rows, columns), prepare.column_stats(n)).select("candidate", "column_index", "error")
    b = fit.constant_fit_discrete(fit.submatrix(c, rows, columns), prepare.frequencies(c)).select("candidate", F.lit(1).alias("column_index"), "error")
    both = candidate(spark, [0], [0, 1])[1]
    assert evaluate.coherence(a.unionByName(b), both).first()["coherence"] == pytest.approx(math.sqrt((0.25 + 0.5625) / 2))


def test_auc_counts_ties_half_at_any_magnitude(spark):
    rng = np.random.default_rng(1)
    r = np.concatenate([rng.integers(0, 40, 150) / 8, 20_000 + rng.integers(0, 20, 150).astype(float)])
    local = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(0, 0, float(x), int(y)) for x, y in zip(r, local)], "candidate long, column_index int, r double, local long")
    inside, outside = r[local == 1], r[local == 0]
    expected = np.mean([1.0 if a < b else 0.5 if a == b else 0.0 for a in inside for b in outside])
    assert contrast.residual_auc(df).first()["auc"] == pytest.approx(expected, abs=1e-12)


def test_pareto_front_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), float(rng.integers(8)), float(rng.integers(8))) for i in range(120)]
    out = {r["id"] for r in archive.pareto_front(spark.createDataFrame(rows, "id long, cell long, loss1 double, loss2 double"), "loss1", "loss2").collect()}
    dominated = lambda a: any(b[1] == a[1] and b[2] <= a[2] and b[3] <= a[3] and (b[2] < a[2] or b[3] < a[3]) for b in rows)
    assert out == {a[0] for a in rows if not dominated(a)}


def brute_archive(rows, capacity):
    """Outcome by sequence, by plain re-evaluation of each cell."""
    better = lambda a, b: a["l1"] <= b["l1"] and a["l2"] <= b["l2"] and (a["l1"], a["l2"]) != (b["l1"], b["l2"])
    cells, out = {}, {}
    for r in rows:
        own = cells.setdefault(r["cell"], [])
        if any(x["sig"] == r["sig"] for x in own):
            out[r["seq"]] = ("REJECTED_DUPLICATE", False, set())
        elif any(better(x, r) for x in own):
            out[r["seq"]] = ("REJECTED_DOMINATED", False, set())
        else:
            after = [x for x in own if not better(r, x)] + [r]
            if len(after) > capacity:
                score = []
                for x in after:
                    total = 0.0
                    for loss in ("l1", "l2"):
                        line = sorted(after, key=lambda y: (y[loss], y["sig"]))
                        k, span = line.index(x), line[-1][loss] - line[0][loss]
                        if span > 0:
                            total += math.inf if k in (0, len(line) - 1) else (line[k + 1][loss] - line[k - 1][loss]) / span
                    score.append(total)
                worst = max((x["sig"] for x, t in zip(after, score) if t == min(score)))
                after = [x for x in after if x["sig"] != worst]
            gone = {x["seq"] for x in own} - {x["seq"] for x in after}
            if r not in after:
                out[r["seq"]] = ("REJECTED_CAPACITY", False, set())
                continue
            out[r["seq"]] = ("INSERTED_WITH_EVICTIONS" if gone else "INSERTED", not own, gone)
            cells[r["cell"]] = after
    return out, {x["seq"] for own in cells.values() for x in own}


def test_archive_fold_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [{"cell": int(rng.integers(3)), "seq": i, "sig": f"s{rng.integers(60):02d}", "l1": float(x), "l2": float(12 - x + rng.integers(-2, 3))} for i, x in enumerate(rng.integers(0, 12, 150))]
    schema = "cell long, sequence long, signature string, loss1 double, loss2 double, violation double, valid boolean"
    data = [(r["cell"], r["seq"], r["sig"], r["l1"], r["l2"], 0.0, True) for r in rows] + [(None, 900, "o", 0.0, 0.0, 0.0, True), (1, 901, "v", 0.0, 0.0, 0.0, False)]
    outcomes = archive.insert_fold(spark.createDataFrame(data, schema), 4)
    got = {r["sequence"]: (r["status"], r["created_cell"], set(r["evicted"])) for r in outcomes.collect()}
    expected, left = brute_archive(rows, 4)
    assert got.pop(900)[0] == "REJECTED_OUT_OF_BOUNDS" and got.pop(901)[0] == "REJECTED_INVALID"
    assert got == expected and {x[0] for x in expected.values()} == set(archive.STATUSES[:2] + archive.STATUSES[4:])
    assert {r["sequence"] for r in archive.survivors(outcomes).collect()} == left


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for shape in ((3, 3), (2, 5), (5, 3)):
        w = rng.random(shape)
        got = sum(w[i, j] for i, j in structure.assignment(w))
        small, big = sorted(shape)
        m = w if shape[0] <= shape[1] else w.T
        assert got == pytest.approx(max(sum(m[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small)))


def test_relevance_uses_independent_bests(spark):
    a_rows = spark.createDataFrame([(0, 0), (0, 1)], "id long, row_index long")
    b_rows = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], a_rows.schema)
    assert structure.relevance(a_rows.select("id").distinct(), structure.overlap(a_rows, b_rows, "row_index"), structure.overlap(a_rows, b_rows, "row_index")).first()["value"] == 1.0
    assert structure.relevance(b_rows.select("id").distinct(), structure.overlap(b_rows, a_rows, "row_index"), structure.overlap(b_rows, a_rows, "row_index")).first()["value"] == 0.5


def test_evidence_cover_matches_brute_force(spark):
    rng = np.random.default_rng(21)
    n, m, floor = 40, 9, 0.5
    rows = {i: sorted(rng.choice(n, rng.integers(6, 20), replace=False).tolist()) for i in range(14)}
    columns = {i: sorted(rng.choice(m, rng.integers(2, 6), replace=False).tolist()) for i in range(14)}
    rows[13], columns[13] = rows[0], columns[0]  # a copy of the first
    quality = {i: 0.55 + 0.03 * i for i in range(13)} | {13: 0.5}
    bits = lambda a, b: math.log2(math.comb(a, b))
    cover, expected = {}, []
    while True:
        gains = []
        for i in set(rows) - set(expected):
            s = max(quality[i] - floor, 0) / (1 - floor)
            own = [cover.get((r, c), 0.0) for r in rows[i] for c in columns[i]]
            net = sum(max(s - x, 0) for x in own) - 0.5 * sum(min(s, x) for x in own) - 0.25 * (bits(n, len(rows[i])) + bits(m, len(columns[i])))
            gains.append((net - 0.5 * len(own) * max(floor - quality[i], 0) / floor, quality[i], len(own), -i, s))
        best = max(gains)
        if best[0] <= 1.0:
            break
        expected.append(-best[3])
        for r in rows[expected[-1]]:
            for c in columns[expected[-1]]:
                cover[r, c] = max(cover.get((r, c), 0.0), best[4])
    frame = lambda members, name: spark.createDataFrame([(i, x) for i, v in members.items() for x in v], f"id long, {name} int")
    got = selection.evidence_cover(spark.createDataFrame(list(quality.items()), "id long, quality double"), frame(rows, "row_index"), frame(columns, "column_index"), n, m)
    assert [r["id"] for r in got.orderBy("rank").collect()] == expected and len(expected) > 2


def test_quality_floor(spark):
    floor = lambda q: selection.quality_knee(spark.createDataFrame([(float(x),) for x in q], "quality double")).first()
    assert floor([0.9] * 3)["source"] == "minimum" and floor([])["floor"] == 0.5
    assert floor([0.7] * 20)[:2] == (0.7, "quantile")
    two = [0.9 - 0.001 * k for k in range(20)] + [0.6 - 0.001 * k for k in range(20)]
    r = floor(two)
    assert r["source"] == "knee" and r["floor"] == pytest.approx((two[19] + two[20]) / 2)


def test_chi_square_of_independent_variables_is_zero(spark):
    x = spark.createDataFrame([(g, a, b) for g in (0, 1) for a in range(3) for b in range(2) for _ in range((a + 1) * (b + 2))], "g int, a int, b int")
    assert [tuple(r)[1:] for r in statistics.chi_square(x, "g", "a", "b").collect()] == [(0.0, 2, 0.0)] * 2
    y = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], x.schema)
    assert statistics.chi_square(y, "g", "a", "b").first()["statistic"] == pytest.approx(2.0)


def test_tail_probabilities():
    assert pvalues.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert pvalues.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert pvalues.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)


def test_multiplicity(spark):
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.20)], "id long, p_value double")
    assert [r["q_value"] for r in statistics.benjamini_hochberg(p, "id").orderBy("id").collect()] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])
    assert [r["adjusted"] for r in statistics.holm(p, "id").orderBy("id").collect()] == pytest.approx([0.04, 0.09, 0.09, 0.2])


def test_contrast_against_all_pairs(spark):
    """Ties, missing values, large magnitudes and more values than ranges: the chance by every pair of rows inside and outside."""
    rng = np.random.default_rng(4)
    columns = [np.round(rng.normal(size=700), 2), rng.integers(0, 4, 700).astype(float), np.round(rng.normal(size=700), 2) * 1e6, np.r_[np.full(500, 7.0), rng.normal(size=200)]]
    columns = [[None if rng.random() < 0.1 else float(v) for v in c] for c in columns]
    cells = numeric(spark, *columns)
    members = {k: sorted(rng.choice(700, size, replace=False).tolist()) for k, size in ((0, 40), (1, 300), (2, 699))}
    rows = spark.createDataFrame([(k, r) for k, m in members.items() for r in m], "candidate long, row_index long")
    chosen = spark.createDataFrame([(k, c) for k in members for c in range(4)], "candidate long, column_index int")
    fits = fit.constant_fit_numeric(fit.submatrix(cells, rows, chosen), prepare.column_stats(cells)).cache()
    parameter = {(r["candidate"], r["column_index"]): r["parameter"] for r in fits.collect()}
    got = {(r["candidate"], r["column_index"]): (r["contrast"], r["valid"]) for r in contrast.constant_contrast_numeric(cells, rows, chosen, fits).collect()}
    assert set(got) == set(parameter) and len(got) == 12
    for (k, c), p in parameter.items():
        inside = [abs(v - p) for r, v in enumerate(columns[c]) if v is not None and r in set(members[k])]
        outside = [abs(v - p) for r, v in enumerate(columns[c]) if v is not None and r not in set(members[k])]
        if len(outside) < 2:
            assert got[k, c] == (0.0, False)
            continue
        tie = 1e-12 if c != 2 else 1e-8
        expected = np.mean([1.0 if b > a + tie else 0.5 if abs(a - b) <= tie else 0.0 for a in inside for b in outside])
        assert got[k, c][1] and got[k, c][0] == pytest.approx(expected, abs=1e-12)
    long = [(k, c, None if v is None else abs(v - parameter[k, c]), int(r in set(members[k]))) for k, c in parameter for r, v in enumerate(columns[c]) if c != 2]
    again = contrast.residual_auc(spark.createDataFrame(long, "candidate long, column_index int, r double, local long")).filter("n_background > 1").collect()
    assert len(again) >= 6 and all(r["auc"] == pytest.approx(got[r["candidate"], r["column_index"]][0], abs=1e-12) for r in again)


def test_submatrix_makes_no_more_rows_than_it_returns(spark):
    """Cells do not meet every candidate that has their column before rows are known."""
    cells = spark.range(300).select(F.col("id").alias("row_index"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("column_index"))
    cells = cells.withColumns({"num": F.rand(3), "code": F.lit(None).cast("int")})
    rows = spark.range(300).select((F.col("id") % 60).alias("candidate"), F.col("id").alias("row_index"))
    columns = spark.range(60).select(F.col("id").alias("candidate"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("column_index"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        out = fit.submatrix(cells, rows, columns)
        assert out.count() == 300 * 6 == out.select("candidate", "row_index", "column_index").distinct().count()
        plan = out._jdf.queryExecution().executedPlan()
        out._jdf.queryExecution().toRdd().count()
        made, todo = [], [plan]
        while todo:
            p = todo.pop()
            if "Join" in p.nodeName():
                made.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made and max(made) <= 300 * 6
