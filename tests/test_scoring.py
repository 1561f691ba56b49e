"""Evaluation of given biclusters against plain Python over all pairs of residuals."""

from __future__ import annotations

import math

import numpy as np
import pytest
import test_joint as plain

from bimosaic.operators import grouping, prepare, scoring

CELLS = "row_index long, column_index int, num double, code int"


def table(spark):
    """90 rows, 10 columns: sums, products, a constant, noise and two discrete columns, with holes."""
    r = np.random.default_rng(33)
    n = 90
    a, p = r.normal(size=n) * 2, np.exp(r.normal(size=n))
    x = np.column_stack([a + 1, a - 3, a + 0.5, p * 2, p * -1, p * 4, np.full(n, 1.5), r.normal(size=n)]) + r.normal(size=(n, 8)) * 0.01
    x[45:] = r.normal(size=(45, 8)) * [3, 3, 3, 6, 4, 9, 2, 1]
    x[r.random(x.shape) < 0.05] = np.nan
    codes = np.column_stack([np.where(np.arange(n) < 45, 1, r.integers(0, 4, n)), r.integers(0, 3, n)])
    codes[r.random(codes.shape) < 0.05] = -1
    cells = [(i, j, None if np.isnan(v) else float(v), None) for i, row in enumerate(x) for j, v in enumerate(row)]
    cells += [(i, 8 + j, None, None if v < 0 else int(v)) for i, row in enumerate(codes) for j, v in enumerate(row)]
    members = {0: (list(range(30)), list(range(10))), 1: (list(range(10, 45)), [0, 1, 3, 4, 8]), 2: (list(range(40, 60)), [2, 6, 7, 9]), 3: (list(range(86)), [0, 6]), 4: ([5], [1, 2]), 5: (list(range(20, 44)), [6, 8])}
    rows = spark.createDataFrame([(k, i) for k, (r_, _) in members.items() for i in r_], "candidate long, row_index long")
    columns = spark.createDataFrame([(k, j) for k, (_, c) in members.items() for j in c], "candidate long, column_index int")
    return x, codes, members, spark.createDataFrame(cells, CELLS), rows, columns


def auc(local, background):
    return np.mean([1.0 if a < b - 1e-12 else 0.5 if abs(a - b) <= 1e-12 else 0.0 for a in local for b in background])


def expected(spark, x, codes, members, cells, patterns, ratio=0.8):
    scale, out = plain.scales(x), {}
    spread = np.nanpercentile(x, 95, axis=0) - np.nanpercentile(x, 5, axis=0)
    stats = prepare.column_stats(cells)
    for k, (rows, cols) in members.items():
        if len(rows) < 2:
            continue
        outside = [i for i in range(len(x)) if i not in rows]
        enough = lambda got, of: len(got) >= max(2, math.ceil(of * ratio)) and len(got) > 0
        numeric = [j for j in cols if j < 8]
        reference, parameter = {}, {}
        for j in numeric:
            v = x[rows, j][np.isfinite(x[rows, j])]
            if enough(v, len(rows)):
                parameter[j] = np.median(v)
                reference[j] = np.mean(np.minimum(1, np.abs(v - parameter[j]) / spread[j]))
        local = dict(reference)
        modes = {}
        for j in (j for j in cols if j >= 8):
            v = [c for c in codes[rows, j - 8] if c >= 0]
            if enough(v, len(rows)):
                modes[j] = min(set(v), key=lambda c: (-v.count(c), c))
                g = len({c for c in codes[:, j - 8] if c >= 0})
                local[j] = (1 - v.count(modes[j]) / len(v)) / (1 - 1 / g)
        proposals = {"additive": [], "multiplicative": []}
        inside = cells.filter(prepare.F.col("row_index").isin(rows) & prepare.F.col("column_index").isin(sorted(reference))).withColumn("candidate", prepare.F.lit(k).cast("long"))
        for p, profiles in (("additive", grouping.additive_profiles), ("multiplicative", grouping.multiplicative_profiles)):
            if p in patterns:
                proposals[p] = [list(r["columns"]) for r in grouping.proposals(grouping.anchor_distances(profiles(inside, stats), either_sign=p == "multiplicative")).collect()]
        b = x[rows]
        got, _ = plain.plain_assignment(b, np.isfinite(b), scale, reference, proposals, patterns, 0.10, ratio)
        if "constant" in patterns:
            got |= {j: ("constant", local[j]) for j in modes}
        contrasts = {}
        for j in cols:
            pattern = got.get(j, (None,))[0]
            if pattern is None:
                contrasts[j] = 0.0
            elif j in modes:
                i_, o_ = ([c for c in codes[w, j - 8] if c >= 0] for w in (rows, outside))
                a, c = (v.count(modes[j]) / len(v) for v in (i_, o_))
                contrasts[j] = (0.5 + 0.5 * (a - c) / (1 - c) if c < 1 else 0.5) if a >= c else (0.5 + 0.5 * (a - c) / c if c > 0 else 0.5)
                contrasts[j] = contrasts[j] if enough(o_, len(outside)) else 0.0
            else:
                if pattern == "constant":
                    r = np.abs(x[:, j] - parameter[j])
                else:
                    own = sorted(c for c, (q, _) in got.items() if q == pattern)
                    names, fitted, _ = plain.fit_group(b, np.isfinite(b), scale, own, pattern, ratio)
                    beta = fitted[1]
                    y = x[:, own] / scale[own] if pattern == "multiplicative" else x[:, own]
                    q = y / beta if pattern == "multiplicative" else y - beta
                    alpha = np.array([np.nanmedian(v) if np.isfinite(v).sum() >= max(2, math.ceil(len(own) * ratio)) else np.nan for v in q])
                    at = own.index(j)
                    r = np.abs(y[:, at] - alpha * beta[at]) if pattern == "multiplicative" else np.abs(y[:, at] - alpha - beta[at])
                i_, o_ = (r[w][np.isfinite(r[w])] for w in (rows, outside))
                contrasts[j] = auc(i_, o_) if enough(i_, len(rows)) and enough(o_, len(outside)) else 0.0
        if len(outside) < max(2, math.ceil(0.1 * len(x))):
            contrasts = dict.fromkeys(cols, 0.0)
        out[k] = got, contrasts
    return out


@pytest.mark.parametrize("patterns", [scoring.ALL, ("constant",)])
def test_evaluation_matches_plain_python(spark, patterns):
    x, codes, members, cells, rows, columns = table(spark)
    found = scoring.evaluate_biclusters(cells, rows, columns, patterns)
    summary = {r["candidate"]: r for r in found.summary.collect()}
    detail = {(r["candidate"], r["column_index"]): r for r in found.columns.collect()}
    issues = {(r["candidate"], r["column_index"], r["code"]) for r in found.issues.collect()}
    want = expected(spark, x, codes, members, cells, patterns)
    assert set(summary) == set(members) and set(detail) == {(k, j) for k in want for j in members[k][1]}
    for k, (got, contrasts) in want.items():
        r_, c_ = members[k]
        for j in c_:
            d = detail[k, j]
            pattern, error = got.get(j, (None, 1.0))
            assert d["pattern"] == pattern, (k, j)
            assert (d["error"], d["contrast"]) == pytest.approx((error, contrasts[j]), abs=1e-9), (k, j, pattern)
            assert (d["reason"] is None) == (pattern is not None)
        s = summary[k]
        coherence = math.sqrt(np.mean([got.get(j, (0, 1.0))[1] ** 2 for j in c_]))
        size = lambda n: 2 * len(r_) / 90 * n / 10 / (len(r_) / 90 + n / 10)
        assert (s["n_rows"], s["n_columns"]) == (len(r_), len(c_))
        assert (s["coherence"], s["contrast"], s["size"]) == pytest.approx((coherence, np.mean([contrasts[j] for j in c_]), size(len(c_))), abs=1e-9)
        assert detail[k, c_[0]]["size_margin"] == pytest.approx(size(len(c_)) - size(len(c_) - 1))
        assert s["violation"] == pytest.approx(max(0, coherence - 0.10))
        assert s["valid"] == (not any(i[0] == k for i in issues)) and s["feasible"] == (s["valid"] and coherence <= 0.10)
    assert summary[4]["coherence"] is None and not summary[4]["valid"] and (4, None, scoring.STRUCTURE) in issues
    assert (3, None, scoring.BACKGROUND) in issues and not summary[3]["feasible"]


def test_evaluation_of_nothing(spark):
    _, _, _, cells, rows, columns = table(spark)
    found = scoring.evaluate_biclusters(cells, rows.limit(0), columns.limit(0))
    assert found.summary.collect() == found.columns.collect() == found.issues.collect() == []
