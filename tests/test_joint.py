"""Joint fits and the mixed assignment against NumPy and plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest

from bimosaic.operators import assignment, fit, grouping, joint, prepare

TINY = 1e-12
CELLS = "row_index long, column_index int, num double, observed boolean"


def needed(n, ratio):
    return max(2, math.ceil(n * ratio))


def nanmed(a, axis=None):
    with np.errstate(all="ignore"):
        a = np.asarray(a, float)
        if a.size == 0 or np.isnan(a).all():
            return np.full(np.delete(a.shape, axis), np.nan) if axis is not None else np.nan
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return np.nanmedian(a, axis)


def fit_once(x, seen, scale, names, pattern, ratio, limit=25):
    """('reject', column, reason) or ('ok', alpha, beta, errors, rounds, converged)."""
    rows, cols = x.shape
    row_need = needed(rows, ratio)
    support = (seen & np.isfinite(x)).sum(0)
    for j in range(cols):
        if support[j] < row_need:
            return "reject", names[j], joint.LOCAL
    product = pattern == joint.MULTIPLICATIVE
    y = x / scale if product else x
    alpha = np.full(rows, np.nan)

    def normal(a, b):
        ok = np.isfinite(a) & (np.abs(a) > TINY)
        if not ok.any():
            return None
        size = np.median(np.abs(a[ok]))
        b = b * size
        a = a / size
        first = [v for v in b if abs(v) > TINY]
        return (-a, -b) if first and first[0] < 0 else (a, b)

    if product:
        spread = np.nanpercentile(y, 95, axis=0) - np.nanpercentile(y, 5, axis=0)
        anchor = max(range(cols), key=lambda j: (spread[j], np.isfinite(y[:, j]).sum(), -j))
        col = y[:, anchor]
        ok = np.isfinite(col) & (np.abs(col) > TINY)
        if not ok.any():
            return "reject", names[0], joint.FAILED
        alpha = col / np.median(np.abs(col[ok]))
        use = np.isfinite(alpha) & (np.abs(alpha) > TINY)
        with np.errstate(all="ignore"):
            q = np.where(use[:, None], y / alpha[:, None], np.nan)
        if np.isnan(q).all(0).any():
            return "reject", names[0], joint.FAILED
        found = normal(alpha, nanmed(q, 0))
        if found is None:
            return "reject", names[0], joint.FAILED
        alpha, beta = found
    else:
        beta = nanmed(y, 0)
    unit = 1.0 if product else np.median(scale)
    for k in range(1, limit + 1):
        with np.errstate(all="ignore"):
            if product:
                use = np.abs(beta) > TINY
                a = nanmed(np.where(use, y / np.where(use, beta, 1), np.nan), 1)
                enough = (seen & np.isfinite(y) & use).sum(1) >= needed(use.sum(), ratio)
                a = np.where(enough & (use.sum() >= 2), a, np.nan)
                rows_in = np.isfinite(a) & (np.abs(a) > TINY)
            else:
                a = np.where((seen & np.isfinite(y)).sum(1) >= needed(cols, ratio), nanmed(y - beta, 1), np.nan)
                rows_in = np.isfinite(a)
            met = (seen & np.isfinite(y) & rows_in[:, None]).sum(0)
            for j in range(cols):
                if met[j] < row_need:
                    return "reject", names[j], joint.GROUP
            b = nanmed(np.where(rows_in[:, None], y / a[:, None] if product else y - a[:, None], np.nan), 0)
        if product:
            found = normal(a, b)
            if found is None:
                return "reject", names[0], joint.FAILED
            a, b = found
        else:
            c = np.nanmedian(a)
            a, b = a - c, b + c
        off = np.inf if (np.isfinite(alpha) != np.isfinite(a)).any() else np.nanmax(np.abs(alpha - a))
        moved = max(off, np.abs(beta - b).max()) / unit
        alpha, beta = a, b
        if moved <= 1e-6:
            break
    model = alpha[:, None] * beta if product else alpha[:, None] + beta
    r = np.minimum(1, np.abs(y - model) / (1 if product else scale))
    return "ok", alpha, beta, np.nanmean(r, 0), k, moved <= 1e-6


def fit_group(x, seen, scale, names, pattern, ratio, limit=25):
    names, gone = list(names), []
    while len(names) >= 2:
        at = np.array(names)
        out = fit_once(x[:, at], seen[:, at], scale[at], names, pattern, ratio, limit)
        if out[0] == "ok":
            return names, out[1:], gone
        gone.append(out[1:])
        names.remove(out[1])
    return [], None, gone


def scales(x):
    p = np.nanpercentile(x, [5, 50, 95], axis=0)
    return np.where(p[2] - p[0] > TINY, p[2] - p[0], np.maximum(np.abs(np.nan_to_num(p[1])), 1))


def block(seed, n=40, m=6, product=False, missing=0.1):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=n), r.normal(size=m) * 3
    x = (np.outer(a, b) if product else a[:, None] + b) + r.normal(size=(n, m)) * 0.1
    x[:, m - 1] = r.normal(size=n)
    x[r.random((n, m)) < missing] = np.nan
    return x


def frames(spark, blocks, seen=None):
    """Blocks side by side as candidates of disjoint rows of one matrix."""
    whole = np.vstack(blocks)
    seen = np.isfinite(whole) if seen is None else seen
    cells = spark.createDataFrame([(i, j, None if np.isnan(v) else float(v), bool(seen[i, j])) for i, row in enumerate(whole) for j, v in enumerate(row)], CELLS)
    at, rows = 0, []
    for k, b in enumerate(blocks):
        rows += [(k, at + i) for i in range(len(b))]
        at += len(b)
    rows = spark.createDataFrame(rows, "candidate long, row_index long")
    return cells, cells.join(rows, "row_index"), whole, seen


@pytest.mark.parametrize("pattern", [joint.ADDITIVE, joint.MULTIPLICATIVE])
@pytest.mark.parametrize("ratio, in_task", [(0.5, 1 << 20), (0.8, 1 << 20), (0.8, 0)])
def test_joint_fits_match_numpy(spark, monkeypatch, pattern, ratio, in_task):
    monkeypatch.setattr(joint, "CELLS_IN_TASK", in_task)  # 0: by rounds over all tasks
    product = pattern == joint.MULTIPLICATIVE
    blocks = [block(k, product=product, missing=0.02 * k) for k in range(6)]
    blocks[1][:, 2] = np.nan
    blocks[1][0, 2] = 4.0  # one observation
    blocks[2][:, 0] = 0.0
    blocks[3][::2, 1:] = np.nan  # few rows have enough columns
    blocks[4] = np.full((12, 6), 2.5)
    whole = np.vstack(blocks)
    seen = np.isfinite(whole) & (np.random.default_rng(7).random(whole.shape) > 0.05)  # some available cells are imputed
    cells, inside, whole, seen = frames(spark, blocks, seen)
    stats = prepare.column_stats(cells)
    groups = inside.select("candidate", "column_index").distinct().withColumn("grp", joint.F.col("candidate"))
    limit = 25 if in_task else 5
    found = joint.fit_groups(inside, groups, stats, pattern, ratio, iterations=limit)
    columns, rows, rejected = ({}, {}, {})
    for r in found.columns.collect():
        columns.setdefault(r["grp"], {})[r["column_index"]] = r
    for r in found.rows.collect():
        rows.setdefault(r["grp"], {})[r["row_index"]] = r["alpha"]
    for r in found.rejected.collect():
        rejected.setdefault(r["grp"], {})[r["column_index"]] = r["reason"]
    scale, at = scales(whole), 0
    fitted = 0
    for k, b in enumerate(blocks):
        s = seen[at : at + len(b)]
        names, out, gone = fit_group(b, s, scale, range(6), pattern, ratio, limit)
        assert sorted(columns.get(k, {})) == names
        assert dict(gone).items() <= rejected.get(k, {}).items()
        if names:
            fitted += 1
            alpha, beta, error, rounds, converged = out
            assert rows[k] == pytest.approx({at + i: v for i, v in enumerate(alpha) if np.isfinite(v)}, abs=1e-9)
            for j, c in enumerate(names):
                r = columns[k][c]
                assert (r["beta"], r["error"]) == pytest.approx((beta[j], error[j]), abs=1e-9)
                assert (r["iterations"], r["converged"]) == (rounds, converged)
        at += len(b)
    assert fitted >= 2


def test_sparse_columns_are_rejected_and_not_called_coherent(spark):
    x = np.array([[1.0, 2, 3, np.nan], [2, 3, 4, np.nan], [3, 4, 5, np.nan], [4, 5, 6, np.nan], [5, 6, 7, 9]])
    cells, inside, *_ = frames(spark, [x])
    out = joint.joint_fit(inside.drop("observed"), prepare.column_stats(cells), "additive").collect()
    assert sorted(r["column_index"] for r in out) == [0, 1, 2] and all(r["error"] == 0 for r in out)


def test_joint_fits_of_nothing(spark):
    cells, inside, *_ = frames(spark, [np.full((3, 4), np.nan)])
    found = joint.fit_groups(inside, inside.select("candidate", "column_index", joint.F.col("candidate").alias("grp")).distinct(), prepare.column_stats(cells), "multiplicative")
    assert found.columns.collect() == found.rows.collect() == [] and {r["reason"] for r in found.rejected.collect()} == {joint.LOCAL}


# mixed assignment


def fit_worth(x, seen, scale, names, pattern, ratio, reference, worth):
    """Fit, and without the worst column again while one improves too little (``reference`` None: any fit will do)."""
    names, gone = list(names), []
    while True:
        names, out, more = fit_group(x, seen, scale, names, pattern, ratio)
        gone += more
        if not names or reference is None:
            return names, out, gone
        deficit = {c: worth - (reference[c] - e) for c, e in zip(names, out[2])}
        worst = max(deficit, key=lambda c: (deficit[c], -c))
        if deficit[worst] <= 0:
            return names, out, gone
        names.remove(worst)
        if len(names) < 2:
            return [], None, gone


def plain_assignment(x, seen, scale, reference, proposals, patterns, worth, ratio):
    """column -> (pattern, error), and the alternatives of each column."""
    joint_names = [p for p in ("additive", "multiplicative") if p in patterns]
    fallback = "constant" in patterns
    best, alternatives = {}, {c: {} for c in reference}
    eligible = sorted(reference)
    for p in joint_names:
        found = []
        for cols in proposals[p] or ([eligible] if len(eligible) >= 2 else []):
            prune = fallback and (len(joint_names) == 1 or not proposals[p])
            names, out, _ = fit_worth(x, seen, scale, cols, p, ratio, reference if prune else None, worth)
            if names:
                e = dict(zip(names, out[2]))
                found.append(((-sum(reference[c] - e[c] for c in names), -len(names), sum(e.values()) / len(names), names), e))
        if found:
            best[p] = min(found, key=lambda f: f[0])[1]
            for c, e in best[p].items():
                alternatives[c][p] = e
    if len(joint_names) == 1 and not fallback:
        best, alternatives, chosen = {}, {c: {} for c in reference}, {joint_names[0]: eligible}
    elif len(joint_names) == 1:
        chosen = {p: sorted(e) for p, e in best.items()}
    else:
        winner = None
        for subset in [s for s in (["additive"], ["multiplicative"], ["additive", "multiplicative"]) if all(p in best for p in s)]:
            choice = {}
            for c in eligible:
                options = [(best[p][c], p) for p in subset if c in best[p] and (not fallback or reference[c] - best[p][c] >= worth)]
                if options:
                    choice[c] = min(options)
            if any(sum(p == q for _, q in choice.values()) < 2 for p in subset):
                continue
            key = (-round(sum(reference[c] - e for c, (e, _) in choice.items()), 12), -len(choice), len(subset), subset)
            if winner is None or key < winner[0]:
                winner = key, choice
        chosen = {p: sorted(c for c, (_, q) in winner[1].items() if q == p) for p in winner[0][3]} if winner else {}
    out = {c: ("constant", reference[c]) for c in reference} if fallback else {}
    for p, cols in chosen.items():
        names, got, _ = fit_worth(x, seen, scale, cols, p, ratio, reference if fallback else None, worth)
        for c, e in zip(names, got[2] if names else []):
            if not fallback:
                e = max(e, min(1, max(0, (worth - (reference[c] - e)) / worth)))
            out[c] = (p, e)
            alternatives[c][p] = e
    if fallback:
        for c in reference:
            alternatives[c]["constant"] = reference[c]
    return out, alternatives


def mixed_blocks():
    """Candidates whose columns follow a sum, a product, a constant or nothing."""
    blocks = []
    for k in range(5):
        r = np.random.default_rng(100 + k)
        n = 30 + 4 * k
        a, p = r.normal(size=n) * 2, np.exp(r.normal(size=n))
        x = np.column_stack([a + 1, a - 3, a + 0.5, p * 2, p * -1, p * 4, np.full(n, 1.5), r.normal(size=n)]) + r.normal(size=(n, 8)) * 0.02 * k
        x[r.random(x.shape) < 0.04 * k] = np.nan
        blocks.append(x)
    blocks.append(np.random.default_rng(9).normal(size=(25, 8)))
    blocks[2][3:, 1] = np.nan
    background = np.random.default_rng(10).normal(size=(120, 8)) * 4
    return blocks, background


@pytest.mark.parametrize("patterns", [("constant", "additive", "multiplicative"), ("additive", "multiplicative"), ("constant", "multiplicative"), ("additive",), ("constant",)])
def test_mixed_assignment_matches_all_subsets(spark, patterns):
    blocks, background = mixed_blocks()
    cells, inside, whole, seen = frames(spark, [*blocks, background])
    inside = inside.filter(f"candidate < {len(blocks)}").withColumn("code", joint.F.lit(None).cast("int")).cache()
    stats, scale = prepare.column_stats(cells), scales(whole)
    constant = fit.constant_fit_numeric(inside, stats)
    references = {}
    for r in constant.collect():
        references.setdefault(r["candidate"], {})[r["column_index"]] = r["error"]
    eligible = inside.join(constant.select("candidate", "column_index"), ["candidate", "column_index"], "left_semi")
    proposals = {k: {"additive": [], "multiplicative": []} for k in range(len(blocks))}
    for p, profiles in (("additive", grouping.additive_profiles), ("multiplicative", grouping.multiplicative_profiles)):
        if p in patterns:
            for r in grouping.proposals(grouping.anchor_distances(profiles(eligible, stats), either_sign=p == "multiplicative")).collect():
                proposals[r["candidate"]][p].append(list(r["columns"]))
    got = assignment.assign(inside, stats, constant, patterns)
    columns, at = {(r["candidate"], r["column_index"]): r for r in got.columns.collect()}, 0
    assert len(columns) == 8 * len(blocks)
    used = set()
    for k, b in enumerate(blocks):
        out, alternatives = plain_assignment(b, np.isfinite(b), scale, references[k], proposals[k], patterns, 0.10, 0.8)
        for c in range(8):
            r = columns[k, c]
            pattern, error = out.get(c, (None, 1.0))
            assert r["pattern"] == pattern, (k, c)
            assert r["error"] == pytest.approx(error, abs=1e-9)
            assert r["grp"] == (None if pattern in (None, "constant") else f"{pattern}-0") and (r["reason"] is None) == (pattern is not None)
            rivals = {p: e for p, e in alternatives.get(c, {}).items() if p != pattern}
            if pattern and rivals:
                assert r["margin"] == pytest.approx(min(rivals.values()) - error, abs=1e-9)
                assert r["ambiguous"] == any(abs(e - error) <= 1e-12 for e in rivals.values())
            used.add(pattern)
        at += len(b)
    assert used >= set(patterns)
    effects = {(r["candidate"], r["pattern"]) for r in got.rows.collect()}
    assert effects == {(k, r["pattern"]) for (k, _), r in columns.items() if r["pattern"] in ("additive", "multiplicative")}
