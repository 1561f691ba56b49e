"""Bundles written and read back, and exact tail probabilities by enumeration."""

from __future__ import annotations

import itertools

import pytest

from bimosaic.functions import pvalues
from bimosaic.operators import statistics
from bimosaic.sources import bundle

CELLS = "row_index long, column_index int, num double, code int"
COLUMNS = "column_index int, name string, kind string, categories array<string>"


def _tables(spark, extra=()):
    cells = [(r, 0, r / 3, None) for r in range(5)] + [(r, 1, None, r % 2 if r else None) for r in range(5)]
    return spark.createDataFrame([*cells, *extra], CELLS), spark.createDataFrame([(0, "x", "numeric", None), (1, "y", "discrete", ["a", "b"])], COLUMNS)


def test_bundle_round_trip(spark, tmp_path):
    cells, columns = _tables(spark)
    bundle.write_bundle(cells, columns, 5, str(tmp_path / "b"), "five")
    got, described = bundle.read_bundle(spark, str(tmp_path / "b"))
    assert sorted(map(str, got.collect())) == sorted(map(str, cells.collect()))
    assert sorted(described.collect()) == sorted(columns.collect())
    manifest, _ = bundle.inspect_bundle(spark, str(tmp_path / "b"))
    assert manifest.first().n_cells == 10 and manifest.first().identifier == "five"


def test_changed_bundle_is_refused(spark, tmp_path):
    cells, columns = _tables(spark)
    bundle.write_bundle(cells, columns, 5, str(tmp_path / "b"), "five")
    cells.limit(1).write.mode("append").parquet(str(tmp_path / "b" / "cells"))
    with pytest.raises(ValueError, match="manifest"):
        bundle.read_bundle(spark, str(tmp_path / "b"))


@pytest.mark.parametrize(
    "cell,fault",
    [((5, 0, 1.0, None), "bad_rows"), ((1, 7, 1.0, None), "bad_columns"), ((1, 0, None, 1), "bad_kinds"), ((1, 1, None, 2), "bad_codes"), ((1, 0, float("nan"), None), "not_finite"), ((1, 0, 2.0, None), "repeated")],
)
def test_unsound_bundle_is_not_written(spark, tmp_path, cell, fault):
    with pytest.raises(ValueError, match=fault):
        bundle.write_bundle(*_tables(spark, [cell]), 5, str(tmp_path / "b"), "five")


@pytest.mark.parametrize("n", [1, 4, 7])
def test_signed_rank_by_enumeration(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 2 + 1):
        tail = min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums)
        assert pvalues.signed_rank_tail(n, w) == pytest.approx(min(1, 2 * tail))


@pytest.mark.parametrize("n1,n2", [(1, 3), (3, 4), (4, 4)])
def test_rank_sum_by_enumeration(n1, n2):
    us = [sum(pick) - n1 * (n1 + 1) // 2 for pick in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        tail = min(sum(v <= u for v in us), sum(v >= u for v in us)) / len(us)
        assert pvalues.rank_sum_tail(n1, n2, u) == pytest.approx(min(1, 2 * tail))


def test_exact_and_approximate_p_values(spark):
    small = [("s", int(v < 3), float(v)) for v in range(7)]
    large = [("l", v % 2, float(v % 5)) for v in range(60)]
    df = spark.createDataFrame(small + large, "g string, m int, v double")
    p = {r.g: r.p_value for r in statistics.mann_whitney_p(df, "g", "m", "v").collect()}
    assert p["s"] == pytest.approx(2 / 35) and p["l"] == pytest.approx(1.0)
    deltas = spark.createDataFrame([("s", float(v)) for v in (1, 2, 3, -4)] + [("t", d) for d in (1.0, 1.0, -1.0, 2.0)], "g string, d double")
    q = {r.g: r.p_value for r in statistics.wilcoxon_p(deltas, "g", "d").collect()}
    assert q["s"] == pytest.approx(14 / 16) and 0.2 < q["t"] < 0.5
