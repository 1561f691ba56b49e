"""Result sets: written and read back, the structural scan, and every fault refused."""

from __future__ import annotations

import pytest
import test_scoring
from pyspark.sql import functions as F

from bimosaic.operators import scoring
from bimosaic.sources import repertoire


@pytest.fixture(scope="module")
def sets(spark, tmp_path_factory):
    _, _, members, cells, rows, columns = test_scoring.table(spark)
    nested = repertoire.from_evaluations(scoring.evaluate_biclusters(cells, rows, columns), rows, columns)
    chosen = F.when(F.col("bicluster_id").isin("0", "1"), F.struct(*[x.alias(n) for n, x in (
        ("selector", F.lit("cover")), ("group_identifier", F.lit("g")), ("selection_rank", F.col("bicluster_id").cast("long")), ("quality_score", F.lit(0.5)),
        ("novelty_score", F.lit(None).cast("double")), ("marginal_gain", F.lit(2.0)), ("source_candidate_identifiers", F.array("bicluster_id")))]))
    nested = nested.withColumn("selection", chosen).withColumn("archive_coordinate", F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).cache()
    names = spark.createDataFrame([(j, f"c{j}", "NUMERIC" if j < 8 else "CATEGORICAL", None) for j in range(10)], "column_index long, name string, kind string, categories array<string>")
    path = str(tmp_path_factory.mktemp("sets") / "set")
    repertoire.write_repertoire(nested, names, path, 90)
    return nested, names, path, members


def plain(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["bicluster_id"])


def test_round_trip(spark, sets):
    nested, names, path, members = sets
    back = repertoire.read_repertoire(spark, path)
    assert back.schema.simpleString() == spark.createDataFrame([], repertoire.NESTED).schema.simpleString()
    assert plain(back) == plain(nested)
    assert {r["bicluster_id"] for r in plain(back)} == {str(k) for k in members}
    first = next(r for r in plain(back) if r["bicluster_id"] == "0")
    assert [p["column_index"] for p in first["patterns"]] == members[0][1] and first["pattern_groups"] and first["pattern_groups"][0]["row_parameters"]
    with pytest.raises(FileExistsError):
        repertoire.write_repertoire(nested, names, path, 90)


def test_structural_scan_reads_members_and_patterns_only(spark, sets):
    nested, _, path, members = sets
    scan = repertoire.structure(spark, path)
    got = {r["bicluster_id"]: r for r in scan.collect()}
    for r in plain(nested):
        assert got[r["bicluster_id"]]["row_indices"] == r["row_indices"]
        assert [(p["column_index"], p["pattern"]) for p in got[r["bicluster_id"]]["patterns"] or []] == [(p["column_index"], p["pattern"]) for p in r["patterns"] or []]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "objectives" not in plan and "error" not in plan


def test_empty_tables_are_left_out(spark, sets, tmp_path):
    nested, names, _, _ = sets
    path = str(tmp_path / "bare")
    bare = nested.filter("bicluster_id = '4'").withColumn("selection", F.lit(None).cast(nested.schema["selection"].dataType))
    repertoire.write_repertoire(bare, names, path, 90)
    import os

    assert sorted(os.listdir(path)) == ["biclusters", "columns"]
    assert plain(repertoire.read_repertoire(spark, path)) == plain(bare)


def changed(t, name, df):
    return {**t, name: df}


FAULTS = {
    "DUPLICATE_IDENTIFIER": lambda t: changed(t, "biclusters", t["biclusters"].unionByName(t["biclusters"].filter("bicluster_id = '0'"))),
    "MEMBERS_NOT_ASCENDING": lambda t: changed(t, "biclusters", t["biclusters"].withColumn("row_indices", F.when(F.col("bicluster_id") == "0", F.reverse("row_indices")).otherwise(F.col("row_indices")))),
    "INDEX_OUT_OF_RANGE": lambda t: changed(t, "columns", t["columns"].withColumn("row_count", F.lit(20))),
    "VALIDITY": lambda t: changed(t, "biclusters", t["biclusters"].withColumn("valid", ~F.col("valid"))),
    "FEASIBILITY": lambda t: changed(t, "biclusters", t["biclusters"].withColumn("feasible", ~F.col("feasible"))),
    "DUPLICATE_SELECTION": lambda t: changed(t, "final-selection", t["final-selection"].unionByName(t["final-selection"])),
    "ORPHAN:final-selection": lambda t: changed(t, "final-selection", t["final-selection"].withColumn("bicluster_id", F.lit("none"))),
    "ORPHAN:column-patterns": lambda t: changed(t, "biclusters", t["biclusters"].filter("bicluster_id <> '1'")),
    "FOREIGN_COLUMN:column-patterns": lambda t: changed(t, "column-patterns", t["column-patterns"].withColumn("column_index", F.col("column_index") + 40)),
    "DUPLICATE:column-objectives": lambda t: changed(t, "column-objectives", t["column-objectives"].unionByName(t["column-objectives"])),
    "UNKNOWN_OBJECTIVE": lambda t: changed(t, "column-objectives", t["column-objectives"].withColumn("objective_name", F.lit("beauty"))),
    "GROUP_MEMBERS": lambda t: changed(t, "pattern-groups", t["pattern-groups"].withColumn("pattern", F.lit("constant"))),
    "UNKNOWN_GROUP": lambda t: changed(t, "pattern-groups", t["pattern-groups"].limit(0)),
    "FOREIGN_ROW": lambda t: changed(t, "pattern-row-parameters", t["pattern-row-parameters"].withColumn("row_index", F.lit(89).cast("long"))),
    "PATTERN_COLUMNS": lambda t: changed(t, "column-patterns", t["column-patterns"].filter("column_index <> 0")),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_faults_are_found(spark, sets, fault):
    t = repertoire.tables(spark, sets[2])
    if fault == "VALIDITY":
        assert repertoire.faults(t).collect() == []
    assert fault in {r["fault"] for r in repertoire.faults(FAULTS[fault](t)).collect()}
