"""First candidates, the coverage plan, and small functions that no query calls."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from bimosaic.operators import initialise, prepare, structure
from bimosaic.plans import results
from bimosaic.sources import bundle, delimited, matrix
from bimosaic.streaming import events


def test_first_candidates_take_turns_and_shapes(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 9)) * 3
    a, b = r.normal(size=25), r.normal(size=5)
    x[:25, :5] = a[:, None] + b
    cells = spark.createDataFrame([(i, j, float(v), None) for i, row in enumerate(x) for j, v in enumerate(row)], "row_index long, column_index int, num double, code int")
    bounds = spark.createDataFrame([(0, 3, 12, 2, 5)], "bound int, min_rows long, max_rows long, min_columns long, max_columns long")
    asked = initialise.pattern_requests(bounds, 9, ("constant", "additive", "multiplicative"), 3)
    assert [q["pattern"] for q in asked.orderBy("candidate").collect()] == ["constant", "additive", "multiplicative"] * 3
    rows, columns, made = initialise.grow(cells, asked, prepare.column_stats(cells))
    shape = {q["candidate"]: (q["n_rows"], q["n_columns"]) for q in made.collect()}
    n = {q["candidate"]: q["count"] for q in rows.distinct().groupBy("candidate").count().collect()}
    m = {q["candidate"]: q["count"] for q in columns.distinct().groupBy("candidate").count().collect()}
    assert shape == {k: (n[k], m[k]) for k in shape} and set(n) == set(m) == set(shape) == set(range(9))
    empty = initialise.grow(cells, asked.limit(0), prepare.column_stats(cells))
    assert [df.count() for df in empty] == [0, 0, 0]


def test_every_cell_is_visited_before_any_is_retried(spark):
    plan = initialise.coverage_plan(spark.range(5).select(F.col("id").alias("cell")), ("constant", "additive"), 2)
    visits, r = [], np.random.default_rng(1)
    for _ in range(8):
        now = initialise.next_targets(plan, 3, most_attempts=4).collect()
        hits = [(q["cell"], q["slot"], bool(r.random() < 0.3)) for q in now]
        visits += [(q["cell"], q["slot"]) for q in now]
        assert len({q["cell"] for q in now}) == len(now)
        if hits:
            plan = spark.createDataFrame(
                initialise.recorded(plan, spark.createDataFrame(hits, "cell long, slot int, hit boolean")).collect(), plan.schema)
    assert {c for c, _ in visits[:5]} == set(range(5))
    tried = {q["cell"]: q["n"] for q in plan.groupBy("cell").agg(F.sum("attempts").alias("n")).collect()}
    done = {q["cell"] for q in plan.groupBy("cell").agg(F.min("made").alias("m")).filter("m").collect()}
    assert all(n <= 4 for n in tried.values()) and sum(tried.values()) == len(visits) and all(c in done or tried[c] == 4 or len(visits) == 24 for c in tried)
    with pytest.raises(ValueError):
        initialise.coverage_plan(plan, ("a", "b", "c"), 2)


def test_neighbour_mates_by_all_pairs(spark):
    r = np.random.default_rng(2)
    at = {i: (int(r.integers(4)), int(r.integers(4))) for i in range(14)}
    j = {(a, b): (float(r.random()), float(r.random())) for a, b in itertools.permutations(at, 2)}
    cells = spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, x int, y int")
    pairs = spark.createDataFrame([(*k, *v) for k, v in j.items()], "a long, b long, row_jaccard double, column_jaccard double")
    for radius in (1, 2):
        got = {(q["a"], q["b"]) for q in structure.neighbour_mates(cells, pairs, radius, 0.4).collect()}
        assert got == {(a, b) for (a, b), v in j.items() if max(abs(at[a][0] - at[b][0]), abs(at[a][1] - at[b][1])) <= radius and min(v) >= 0.4}


def test_small_sources(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0, None), (0, 1, None, 2), (1, 0, float("nan"), None), (1, 1, None, None)], "row_index long, column_index int, num double, code int")
    assert prepare.reject_missing(cells.filter("row_index = 0")).count() == 2
    with pytest.raises(Exception, match="missing value"):
        prepare.reject_missing(cells).collect()
    with pytest.raises(Exception, match="finite"):
        matrix.reject_not_finite(cells).collect()
    assert matrix.reject_not_finite(cells.filter("row_index = 0")).count() == 2
    assert [tuple(q)[:2] for q in matrix.slice_cells(cells, [1], [0, 1]).orderBy("column_index").collect()] == [(1, 0), (1, 1)]
    texts = spark.createDataFrame([("1,5",), ("2.5",), (None,)], "v string")
    assert [q[0] for q in texts.select(delimited.decimal_comma(F.col("v"))).collect()] == ["1.5", "2.5", None]
    lists = spark.createDataFrame([(1, [3, 4, 3]), (2, None)], "id long, rows array<long>")
    assert sorted(map(tuple, delimited.index_members(lists, "id", "rows", "row_index").collect())) == [(1, 3), (1, 4)]
    assert [q["json"] for q in results.export_json(lists, ["id", "rows"]).orderBy("id").collect()] == ['{"id":1,"rows":[3,4,3]}', '{"id":2}']
    members = spark.createDataFrame([(2, "a"), (1, "b"), (1, "a")], "cell long, signature string")
    assert [tuple(q) for q in results.canonical(members).collect()] == [(1, "a"), (1, "b"), (2, "a")]


def test_bundles_appear_whole(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, float(i), None) for i in range(3) for j in range(2)], "row_index long, column_index int, num double, code int")
    columns = spark.createDataFrame([(0, "a", "numeric", None), (1, "b", "numeric", None)], "column_index int, name string, kind string, categories array<string>")
    path = str(tmp_path / "one")
    bundle.write_bundle(cells, columns, 3, path, "x")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one"] and bundle.read_bundle(spark, path)[0].count() == 6
    with pytest.raises(FileExistsError):
        bundle.write_bundle(cells, columns, 3, path, "x")


def test_streams_agree_with_batches(spark, tmp_path):
    kinds = ["click", "view", "error"]
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", kinds[i % 3], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.filter("event_id < 50").write.parquet(str(tmp_path / "in"))
    run = lambda name: events.stream_outcome_rates(spark, str(tmp_path / "in"), df.schema, 20, str(tmp_path / "state"), name).awaitTermination()
    run("rates_one")
    df.filter("event_id >= 50").write.mode("append").parquet(str(tmp_path / "in"))
    batch = events.outcome_rates(df.select(F.col("event_id").alias("step"), F.col("event_type").alias("kind")), 20).orderBy("window").collect()
    spark.streams.resetTerminated()
    events.stream_outcome_rates(spark, str(tmp_path / "in"), df.schema, 20, str(tmp_path / "fresh"), "rates_two").awaitTermination()
    assert spark.table("rates_two").orderBy("window").collect() == batch
    windows = events.stream_windows(spark, str(tmp_path / "in"), df.schema, "10 minutes", "1 minute")
    windows.writeStream.outputMode("complete").format("memory").queryName("by_time").trigger(availableNow=True).start().awaitTermination()
    want = df.groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    assert sorted(map(str, spark.table("by_time").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("size", [50_000, 7])
def test_percentiles_by_ranges_are_exact(spark, monkeypatch, size):
    monkeypatch.setattr(prepare, "IN_RANGE", size)
    r = np.random.default_rng(4)
    values = {0: r.normal(size=300), 1: r.integers(0, 5, 200).astype(float), 2: np.array([3.5]), 3: np.repeat(2.0, 50), 4: np.array([])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [(k, None) for k in values]
    df = spark.createDataFrame(rows, "column_index int, num double").repartition(5)
    at = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]
    got = {q["column_index"]: q for q in prepare.exact_percentiles(df, ["column_index"], "num", at).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, q in got.items():
        assert q["n"] == len(values[k]) and q["p"] == pytest.approx(np.quantile(values[k], at).tolist(), abs=1e-12)
    same = lambda x: sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in q) for q in x.collect()), key=str)
    assert same(prepare.column_stats(df, by_ranges=True)) == same(prepare.column_stats(df))
    assert prepare.exact_percentiles(df.limit(0), ["column_index"], "num", at).collect() == []
