"""Membership moves, column groups, run metrics and stored results: brute force and edge cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bimosaic.operators import grouping, moves
from bimosaic.plans import results
from bimosaic.streaming import observers


def _groups(df, key, value):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r[value])
    return out


def test_moves_change_one_element_and_keep_bounds(spark):
    held = {1: {0, 1, 2}, 2: {3, 4}, 3: set(range(6)), 4: {5, 1, 2, 0}}
    members = spark.createDataFrame([(c, e) for c, es in held.items() for e in es], "candidate long, row_index long")
    universe = spark.range(6).withColumnRenamed("id", "row_index")
    for operation in moves.OPERATIONS:
        got = _groups(moves.random_move(members, universe, "row_index", operation), "candidate", "row_index")
        able = {c for c, es in held.items() if (len(es) > 2 if operation == "remove" else len(es) < 6)}
        assert set(got) == able
        for c in able:
            lost, won = held[c] - got[c], got[c] - held[c]
            assert (len(lost), len(won)) == {"add": (0, 1), "remove": (1, 0), "swap": (1, 1)}[operation]
            assert got[c] <= set(range(6))


def test_outside_gives_every_missing_element_once(spark):
    rng = random.Random(5)
    held = {c: set(rng.sample(range(40), rng.randrange(1, 40))) for c in range(8)}
    members = spark.createDataFrame([(c, e) for c, es in held.items() for e in es], "candidate long, e long")
    universe = spark.range(40).withColumnRenamed("id", "e")
    got = _groups(moves.outside(members, universe, "e", 64), "candidate", "e")
    assert got == {c: set(range(40)) - es for c, es in held.items()}
    few = moves.outside(members, universe, "e", 5).collect()
    assert len(few) == len({(r.candidate, r.e) for r in few}) == sum(min(5, 40 - len(es)) for es in held.values())
    assert all(r.e not in held[r.candidate] and 0 <= r.e < 40 for r in few)


def test_guided_move_takes_worst_and_best(spark):
    members = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "candidate long, c long")
    universe = spark.range(6).withColumnRenamed("id", "c")
    loss = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9), (1, 2, 0.9), (1, 4, 0.1), (1, 5, 0.1)], "candidate long, c long, loss double")
    got = _groups(moves.guided_move(members, universe, "c", "swap", lambda pool: loss), "candidate", "c")
    assert got == {1: {0, 1, 4}}


def _brute_groups(columns, minimum, most):
    """The rule in plain Python: columns {index: (values, scale)}, None where missing."""
    n = len(next(iter(columns.values()))[0])
    need = max(2, -(-n * 4 // 5))

    def apart(a, b):
        if a == b:
            return 0.0
        (x, s), (y, t) = columns[a], columns[b]
        both = [(u, v) for u, v in zip(x, y, strict=True) if u is not None and v is not None]
        return round(sum(min(1, abs(u - v) / max(s, t)) for u, v in both) / len(both), 12) if len(both) >= need else None

    anchors = [min(columns, key=lambda c: (-sum(v is not None for v in columns[c][0]), c))]
    while len(anchors) < most:
        far = {}
        for c in set(columns) - set(anchors):
            known = [d for a in anchors if (d := apart(a, c)) is not None]
            if known and min(known) > 1e-12:
                far[c] = min(known)
        if not far:
            break
        anchors.append(max(far, key=lambda c: (far[c], -c)))
    out = set()
    for a in anchors:
        order = sorted((d, c) for c in columns if (d := apart(a, c)) is not None)
        if len(order) < minimum:
            continue
        gaps = [(order[k][0] - order[k - 1][0], -k) for k in range(minimum, len(order))]
        cut = -max(gaps)[1] if gaps and max(gaps)[0] > 1e-12 else len(order)
        out |= {tuple(sorted(c for _, c in order[:k])) for k in (cut, minimum)}
    return out


def test_column_groups_by_brute_force(spark):
    rng = random.Random(11)
    table, expected = [], {}
    for candidate in range(4):
        base = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(3)]
        columns = {}
        for c in range(10):
            values = [None if rng.random() < 0.08 else round(v + rng.gauss(0, 0.05), 4) for v in base[c % 3]]
            columns[c] = (values, 1.0 + c % 2)
            table += [(candidate, r, c, v, 1.0 + c % 2) for r, v in enumerate(values)]
        expected[candidate] = _brute_groups(columns, 3, 4)
    profiles = spark.createDataFrame(table, "candidate long, row_index long, column_index int, p double, scale double")
    got = {}
    for r in grouping.proposals(grouping.anchor_distances(profiles, anchors=4), 3).collect():
        got.setdefault(r.candidate, set()).add(tuple(r.columns))
    assert got == expected


def test_opposite_profiles_are_near_with_either_sign(spark):
    x = [1.0, -2.0, 3.0, 0.5]
    rows = [(1, r, c, s * v, 1.0) for r, v in enumerate(x) for c, s in enumerate((1, -1))]
    profiles = spark.createDataFrame(rows, "candidate long, row_index long, column_index int, p double, scale double")
    near = {r.column_index: r.distance for r in grouping.anchor_distances(profiles, 1, either_sign=True).collect()}
    far = {r.column_index: r.distance for r in grouping.anchor_distances(profiles, 1).collect()}
    assert near == {0: 0.0, 1: 0.0} and far[1] == 1.0


def test_empty_inputs_give_no_rows(spark):
    profiles = spark.createDataFrame([], "candidate long, row_index long, column_index int, p double, scale double")
    assert grouping.proposals(grouping.anchor_distances(profiles)).isEmpty()
    outcomes = spark.createDataFrame([], "step long, id long, cell long, status string, evicted array<long>")
    assert observers.archive_diagnostics(outcomes, 10).isEmpty() and observers.residents(outcomes, 10).isEmpty()
    assert observers.issues(spark.createDataFrame([], "step long, issues array<string>"), 10).isEmpty()


def test_residents_leave_when_driven_out(spark):
    rows = [(1, 1, 0, "INSERTED", []), (11, 2, 0, "INSERTED_WITH_EVICTIONS", [1]), (12, 3, 0, "REJECTED_DOMINATED", [2]), (25, 4, 1, "INSERTED", []), (26, 5, 1, "INSERTED_WITH_EVICTIONS", [4])]
    outcomes = spark.createDataFrame(rows, "step long, id long, cell long, status string, evicted array<long>")
    assert _groups(observers.residents(outcomes, 10), "window", "id") == {1: {1}, 2: {2}, 3: {2, 5}}


@pytest.mark.parametrize("n,count", list(itertools.product((0, 1, 5, 101), (1, 2, 7))))
def test_spread_sample(spark, n, count):
    got = sorted(r.id for r in results.spread_sample(spark.range(n), "id", count).collect())
    expected = list(range(n)) if n <= count else sorted({int(j * ((n - 1) / max(count - 1, 1))) for j in range(count)})
    assert got == expected


def test_feasible_shape_by_brute_force(spark):
    rng = random.Random(3)
    supports = [rng.randrange(0, 60) for _ in range(12)]
    wanted = [(i, rng.randrange(1, 80), rng.randrange(2, 30), rng.randrange(10, 90), rng.randrange(1, 15), rng.randrange(1, 8), rng.randrange(2, 14)) for i in range(150)]
    expected = {}
    for shape, rows, low, high, columns, least, most in wanted:
        if low > high or least > most:
            continue
        start = min(max(rows, low), high)
        for n in [start, *range(start - 1, low - 1, -1), *range(start + 1, high + 1)]:
            fit = sum(v >= max(2, -(-n * 4 // 5)) for v in supports)
            if min(most, fit) >= least:
                expected[shape] = (n, min(max(columns, least), min(most, fit)))
                break
    w = spark.createDataFrame(wanted, "shape long, rows long, min_rows long, max_rows long, columns long, min_columns long, max_columns long")
    got = results.feasible_shapes(w, spark.createDataFrame(list(enumerate(supports)), "column_index int, support long"))
    assert {r.shape: (r.n_rows, r.n_columns) for r in got.collect()} == expected


def test_feasible_shapes_of_a_wide_table(spark):
    """Shapes meet the distinct supports; no row holds the supports of all columns."""
    supports = spark.range(5000).select("id", (F.col("id") % 37).alias("support")).withColumnRenamed("id", "column_index")
    wanted = [(i, i % 50 + 1, 2, 60, 5000, 1 + i * 131 % 6000, 6000) for i in range(300)]
    w = spark.createDataFrame(wanted, "shape long, rows long, min_rows long, max_rows long, columns long, min_columns long, max_columns long")
    out = results.feasible_shapes(w, supports)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    have = [i % 37 for i in range(5000)]
    expected = {}
    for shape, rows, low, high, columns, least, most in wanted:
        for n in range(min(max(rows, low), high), low - 1, -1):
            fit = sum(v >= max(2, -(-n * 4 // 5)) for v in have)
            if fit >= least:
                expected[shape] = (n, min(max(columns, least), most, fit))
                break
    assert {r.shape: (r.n_rows, r.n_columns) for r in out.collect()} == expected


def test_archive_distributions_without_a_row_for_each_member_and_window(spark, monkeypatch):
    """Statistics of each window from comings and goings, equal to those of the members listed window by window."""
    rng = random.Random(5)
    steps = [(i, i, rng.choice([None, 1, 2, 3]), "INSERTED" if rng.random() < 0.7 else "REJECTED_INVALID", [rng.randrange(max(1, i))] if i % 3 == 0 else []) for i in range(600)]
    outcomes = spark.createDataFrame(steps, "id long, step long, cell long, status string, evicted array<long>")
    value = {i: {"wide": rng.choice([1e300, -1e300, rng.gauss(0, 1)]) if i < 100 else rng.gauss(0, 1), "few": float(rng.randrange(4))} for i in range(600)}
    value[7]["few"] = None
    d = spark.createDataFrame([(i, n, v) for i, own in value.items() for n, v in own.items()], "id long, name string, value double")
    there = {w: set(ids) for w, ids in _groups(observers.residents(outcomes, 20), "window", "id").items()}
    monkeypatch.setattr(observers, "residents", None)
    got = {(r.window, r.metric): r.value for r in observers.archive_distributions(outcomes, d, 20).collect()}
    expected = {}
    for w, ids in there.items():
        lists = {f"archive_descriptor.{n}": sorted(value[i][n] for i in ids if value[i][n] is not None) for n in ("wide", "few")}
        lists["archive_cell.members"] = sorted(float(sum(steps[i][2] == c for i in ids)) for c in {steps[i][2] for i in ids})
        for name, own in lists.items():
            if not own:
                continue
            at = lambda q: own[int(q * (len(own) - 1))] + (own[min(len(own) - 1, int(q * (len(own) - 1)) + 1)] - own[int(q * (len(own) - 1))]) * (q * (len(own) - 1) % 1)
            six = [own[0], at(0.25), at(0.5), sum(sorted(own, key=abs)) / len(own), at(0.75), own[-1]]
            expected |= {(w, f"{name}.{s}"): v for s, v in zip(observers.STATISTICS, six)}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        if k[1] == "archive_descriptor.wide.mean" and any(abs(value[i]["wide"]) > 1e299 for i in there[k[0]]):
            continue  # sums of numbers of such sizes depend on their order
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9), k
