"""Delimited files and result tables, read and written."""

from __future__ import annotations

import pytest

from bimosaic.sources import delimited


def test_read_and_infer(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d\n1,yes,x,?\n2.5,NO,NA,\nnan,,1,null\n")
    df = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    found = {r["name"]: (r["kind"], r["n_observed"], r["n_distinct"]) for r in delimited.infer_kinds(df).collect()}
    assert found == {"a": ("numeric", 2, 2), "b": ("boolean", 2, 2), "c": ("categorical", 2, 2), "d": ("categorical", 0, 0)}
    (tmp_path / "b.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path / "b.csv"))


def test_results_round_trip(spark, tmp_path):
    results = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    rows = spark.createDataFrame([(1, 5), (1, 3), (1, 3)], "id long, row_index long")
    columns = spark.createDataFrame([(1, 0), (2, 7)], "id long, column_index int")
    nested = delimited.nested_results(results, rows, columns)
    assert sorted(map(tuple, nested.collect()), key=lambda r: r[0]) == [(1, "x", [3, 5], [0]), (2, "y", None, [7])]
    delimited.write_results({"results": nested}, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv/results"))
    assert {r["id"]: r["rows"] for r in back.collect()} == {"1": "[3,5]", "2": None}
    delimited.write_results({"results": nested}, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet/results")).count() == 2
