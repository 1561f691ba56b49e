"""Result sets on disk: evaluated biclusters as seven tables, written as one, read back whole or in part, and checked.

In memory a result set is one row a bicluster with nested details (``NESTED``). On disk the details are tables of their own, ordered
by bicluster, so that a reader takes only what it needs: the structural scan reads memberships and patterns. Tables without rows are
left out. A set is written beside its place and then renamed, so a reader sees all of it or nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import beside, exists, put

ISSUE = "struct<code:string,message:string,column_index:bigint,pattern:string>"
NAMED = "struct<name:string,value:double>"
NESTED = (
    "bicluster_id string, generation bigint, provenance_json string, row_indices array<bigint>, column_indices array<bigint>, archive_coordinate array<bigint>, "
    "objectives array<struct<name:string,direction:string,value:double,columns:array<struct<column_index:bigint,value:double,valid:boolean>>>>, "
    f"constraints array<{NAMED}>, descriptors array<{NAMED}>, issues array<{ISSUE}>, "
    "patterns array<struct<column_index:bigint,pattern:string,group_identifier:string,error:double,parameter:double,reference:double,margin:double,equivalents:string>>, "
    "pattern_groups array<struct<group_identifier:string,pattern:string,column_indices:array<bigint>,iterations:bigint,converged:boolean,row_parameters:array<struct<row_index:bigint,value:double>>>>, "
    "selection struct<selector:string,group_identifier:string,selection_rank:bigint,quality_score:double,novelty_score:double,marginal_gain:double,source_candidate_identifiers:array<string>>, "
    "valid boolean, feasible boolean"
)
#: Detail tables: how to take them out of the nested rows, and by what their rows are ordered within a bicluster.
DETAILS: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "column-patterns": (lambda d: d.select("bicluster_id", F.inline("patterns")), ["column_index"]),
    "column-objectives": (
        lambda d: d.select("bicluster_id", F.posexplode("objectives").alias("place", "o")).select("bicluster_id", "place", F.col("o.name").alias("objective_name"), F.inline("o.columns")),
        ["place", "column_index"],
    ),
    "pattern-groups": (lambda d: d.select("bicluster_id", F.explode("pattern_groups").alias("g")).select("bicluster_id", "g.*").drop("row_parameters"), ["group_identifier"]),
    "pattern-row-parameters": (
        lambda d: d.select("bicluster_id", F.explode("pattern_groups").alias("g")).select("bicluster_id", F.col("g.group_identifier").alias("group_identifier"), F.inline("g.row_parameters")),
        ["group_identifier", "row_index"],
    ),
    "final-selection": (lambda d: d.filter("selection IS NOT NULL").select("bicluster_id", "selection.*"), []),
}
HEAD = ["bicluster_id", "generation", "provenance_json", "row_indices", "column_indices", "archive_coordinate", "objectives", "constraints", "descriptors", "issues", "has_pattern_fit", "valid", "feasible"]


def _schemas(spark: SparkSession) -> dict[str, str]:
    empty = spark.createDataFrame([], NESTED)
    tables = {name: take(empty).schema for name, (take, _) in DETAILS.items()} | {"biclusters": head(empty).schema}
    return {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) for name, schema in tables.items()}


def head(nested: DataFrame) -> DataFrame:
    """The bicluster table: everything but column and row details."""
    slim = F.transform("objectives", lambda o: F.struct(o["name"].alias("name"), o["direction"].alias("direction"), o["value"].alias("value")))
    return nested.withColumn("objectives", slim).withColumn("has_pattern_fit", F.col("patterns").isNotNull()).select(*HEAD)


def write_repertoire(nested: DataFrame, columns: DataFrame, path: str, row_count: int) -> None:
    """Write a result set; ``columns``: column_index, name, kind, categories of the table it is about, ``row_count`` its rows."""
    spark = nested.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    aside = beside(path)
    save = lambda df, name, order: df.repartitionByRange("bicluster_id").sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{aside}/{name}")
    save(head(nested), "biclusters", ["bicluster_id"])
    for name, (take, order) in DETAILS.items():
        rows = take(nested)
        if not rows.isEmpty():
            save(rows, name, ["bicluster_id", *order])
    columns.withColumn("row_count", F.lit(row_count).cast("long")).write.parquet(f"{aside}/columns")
    put(spark, aside, path)


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a result set, those that were left out without rows."""
    out = {"columns": spark.read.parquet(f"{path}/columns")}
    for name, schema in _schemas(spark).items():
        out[name] = spark.read.schema(schema).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
    return out


def structure(spark: SparkSession, path: str) -> DataFrame:
    """bicluster_id, row_indices, column_indices, patterns (column_index, pattern): the structural scan; no other column is read."""
    t = tables(spark, path)
    own = t["column-patterns"].groupBy("bicluster_id").agg(F.sort_array(F.collect_list(F.struct("column_index", "pattern"))).alias("patterns"))
    return t["biclusters"].select("bicluster_id", "row_indices", "column_indices").join(own, "bicluster_id", "left")


def faults(t: dict[str, DataFrame]) -> DataFrame:
    """bicluster_id, fault, of everything in the tables that does not hold together; empty for a sound set."""
    b = t["biclusters"]
    say = lambda df, fault: df.select("bicluster_id", F.lit(fault).alias("fault"))
    size = t["columns"].agg(F.max("row_count").alias("all_rows"), (F.max("column_index") + 1).alias("all_columns"))  # one row
    sized = b.crossJoin(F.broadcast(size))
    ascending = lambda c: (F.col(c) == F.array_sort(F.array_distinct(c))) & (F.size(c) > 0)
    outside = lambda c, n: F.exists(c, lambda v: (v < 0) | (v >= F.col(n)))
    out = [
        say(b.groupBy("bicluster_id").count().filter("count > 1 OR bicluster_id IS NULL"), "DUPLICATE_IDENTIFIER"),
        say(b.filter(~F.coalesce(ascending("row_indices") & ascending("column_indices"), F.lit(False))), "MEMBERS_NOT_ASCENDING"),
        say(sized.filter(outside("row_indices", "all_rows") | outside("column_indices", "all_columns")), "INDEX_OUT_OF_RANGE"),
        say(b.filter(~F.col("valid").eqNullSafe(F.size("issues") == 0)), "VALIDITY"),
        say(b.filter(~F.col("feasible").eqNullSafe(F.col("valid") & (F.aggregate("constraints", F.lit(0.0), lambda s, c: s + F.greatest(F.lit(0.0), c["value"])) <= 0))), "FEASIBILITY"),
        say(t["final-selection"].groupBy("bicluster_id").count().filter("count > 1"), "DUPLICATE_SELECTION"),
    ]
    for name in DETAILS:
        out.append(say(t[name].join(b.select("bicluster_id"), "bicluster_id", "left_anti"), f"ORPHAN:{name}"))
    members = b.select("bicluster_id", "row_indices", "column_indices")
    for name in ("column-patterns", "column-objectives"):
        rows = t[name].join(members, "bicluster_id")
        out.append(say(rows.filter(~F.array_contains("column_indices", F.col("column_index"))), f"FOREIGN_COLUMN:{name}"))
        key = ["bicluster_id", "column_index"] + (["objective_name"] if name == "column-objectives" else [])
        out.append(say(t[name].groupBy(*key).count().filter("count > 1"), f"DUPLICATE:{name}"))
    named = b.select("bicluster_id", F.explode(F.col("objectives.name")).alias("objective_name"))
    out.append(say(t["column-objectives"].join(named, ["bicluster_id", "objective_name"], "left_anti"), "UNKNOWN_OBJECTIVE"))
    g = t["pattern-groups"]
    held = t["column-patterns"].filter("group_identifier IS NOT NULL").groupBy("bicluster_id", "group_identifier").agg(
        F.array_sort(F.collect_list("column_index")).alias("own"), F.array_distinct(F.collect_list("pattern")).alias("kinds")
    )
    both = held.join(g, ["bicluster_id", "group_identifier"], "full")
    out.append(say(both.filter(~F.coalesce((F.col("own") == F.col("column_indices")) & (F.col("kinds") == F.array("pattern")), F.lit(False))), "GROUP_MEMBERS"))
    parameters = t["pattern-row-parameters"]
    out.append(say(parameters.join(g.select("bicluster_id", "group_identifier"), ["bicluster_id", "group_identifier"], "left_anti"), "UNKNOWN_GROUP"))
    out.append(say(parameters.join(members, "bicluster_id").filter(~F.array_contains("row_indices", F.col("row_index"))), "FOREIGN_ROW"))
    whole = t["column-patterns"].groupBy("bicluster_id").agg(F.count(F.lit(1)).alias("n"))
    fit = b.join(whole, "bicluster_id", "left").filter(F.when(F.col("has_pattern_fit"), F.coalesce("n", F.lit(0)) != F.size("column_indices")).otherwise(F.col("n").isNotNull()))
    out.append(say(fit, "PATTERN_COLUMNS"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.distinct()


def read_repertoire(spark: SparkSession, path: str) -> DataFrame:
    """The result set as nested rows again, details in order; a ValueError names what does not hold together."""
    t = tables(spark, path)
    bad = faults(t).orderBy("fault", "bicluster_id").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['bicluster_id']}: {r['fault']}" for r in bad))
    ordered = lambda df, by, fields: df.groupBy("bicluster_id").agg(F.sort_array(F.collect_list(F.struct(*by, F.struct(*fields).alias("v")))).alias("x")).select("bicluster_id", F.transform("x", lambda s: s["v"]).alias("x"))
    rest = lambda name, *drop: [c for c in t[name].columns if c not in ("bicluster_id", *drop)]
    patterns = ordered(t["column-patterns"], ["column_index"], rest("column-patterns")).withColumnRenamed("x", "patterns")
    values = t["pattern-row-parameters"].groupBy("bicluster_id", "group_identifier").agg(F.sort_array(F.collect_list(F.struct("row_index", "value"))).alias("row_parameters"))
    groups = t["pattern-groups"].join(values, ["bicluster_id", "group_identifier"], "left").withColumn("row_parameters", F.coalesce("row_parameters", F.array().cast("array<struct<row_index:bigint,value:double>>")))
    groups = ordered(groups, ["group_identifier"], [*rest("pattern-groups"), "row_parameters"]).withColumnRenamed("x", "pattern_groups")
    detail = t["column-objectives"].groupBy("bicluster_id", "place").agg(F.sort_array(F.collect_list(F.struct("column_index", "value", "valid"))).alias("columns"))
    summary = t["biclusters"].select("bicluster_id", F.posexplode("objectives").alias("place", "o")).join(detail, ["bicluster_id", "place"], "left")
    none: Column = F.array().cast("array<struct<column_index:bigint,value:double,valid:boolean>>")
    objective = F.struct("place", F.struct("o.name", "o.direction", "o.value", F.coalesce("columns", none).alias("columns")).alias("v"))
    objectives = summary.groupBy("bicluster_id").agg(F.transform(F.sort_array(F.collect_list(objective)), lambda s: s["v"]).alias("own_objectives"))
    selection = t["final-selection"].select("bicluster_id", F.struct(*rest("final-selection")).alias("selection"))
    out = t["biclusters"]
    for part in (patterns, groups, objectives, selection):
        out = out.join(part, "bicluster_id", "left")
    wanted = dict((f.name, f.dataType) for f in spark.createDataFrame([], NESTED).schema)
    empty = lambda c: F.array().cast(wanted[c])
    out = out.withColumn("objectives", F.coalesce("own_objectives", empty("objectives")))
    out = out.withColumn("pattern_groups", F.when(F.col("has_pattern_fit"), F.coalesce("pattern_groups", empty("pattern_groups"))))
    return out.select(*[F.col(c).cast(k).alias(c) for c, k in wanted.items()])


def from_evaluations(found, rows: DataFrame, columns: DataFrame, generation: int = 0) -> DataFrame:
    """Nested rows of ``scoring.Evaluations`` and the members (candidate, row_index), (candidate, column_index) they are about."""
    gather = lambda df, key, *fields: df.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(key))
    long = lambda c: F.col(c).cast("long").alias(c)
    r = rows.groupBy("candidate").agg(F.array_sort(F.collect_set(long("row_index"))).alias("row_indices"))
    c = columns.groupBy("candidate").agg(F.array_sort(F.collect_set(long("column_index"))).alias("column_indices"))
    d = found.columns
    patterns = gather(d, "patterns", long("column_index"), "pattern", F.col("grp").alias("group_identifier"), "error", "parameter", "reference", "margin", "equivalents")
    part = lambda name, way, v, ok: F.struct(F.lit(name).alias("name"), F.lit(way).alias("direction"), F.col(f"s_{name}").alias("value"), F.transform("details", lambda x: F.struct(x["column_index"].alias("column_index"), x[v].alias("value"), x[ok].alias("valid"))).alias("columns"))
    details = gather(d.withColumns({"known": F.col("pattern").isNotNull(), "compared": F.col("pattern").isNotNull() & (F.col("contrast") > 0)}), "details", long("column_index"), "error", "contrast", "known", "compared")
    effects = found.effects.groupBy("candidate", "pattern").agg(F.sort_array(F.collect_list(F.struct("row_index", F.col("alpha").alias("value")))).alias("row_parameters"))
    groups = d.filter("grp IS NOT NULL").groupBy("candidate", "pattern", F.col("grp").alias("group_identifier")).agg(F.array_sort(F.collect_list(long("column_index"))).alias("column_indices")).join(effects, ["candidate", "pattern"], "left")
    groups = gather(groups, "pattern_groups", "group_identifier", "pattern", "column_indices", F.lit(None).cast("long").alias("iterations"), F.lit(None).cast("boolean").alias("converged"), "row_parameters")
    issues = gather(found.issues, "issues", "code", F.lit("").alias("message"), long("column_index"), F.lit(None).cast("string").alias("pattern"))
    s = found.summary.withColumnsRenamed({"coherence": "s_coherence", "contrast": "s_contrast"}).drop("n_rows", "n_columns")
    for x in (r, c, patterns, details, groups, issues):
        s = s.join(x, "candidate", "left")
    wanted = {f.name: f.dataType for f in s.sparkSession.createDataFrame([], NESTED).schema}
    sound = F.col("s_coherence").isNotNull()
    value = {
        "bicluster_id": F.col("candidate").cast("string"), "generation": F.lit(generation), "provenance_json": F.lit(None),
        "archive_coordinate": F.lit(None), "objectives": F.when(sound, F.array(part("coherence", "MINIMIZE", "error", "known"), part("contrast", "MAXIMIZE", "contrast", "compared"))).otherwise(F.array().cast(wanted["objectives"])),
        "constraints": F.when(sound, F.array(F.struct(F.lit("violation").alias("name"), F.col("violation").alias("value")))).otherwise(F.array().cast(wanted["constraints"])),
        "descriptors": F.when(sound, F.array(F.struct(F.lit("balanced_bicluster_size").alias("name"), F.col("size").alias("value")))).otherwise(F.array().cast(wanted["descriptors"])),
        "issues": F.coalesce("issues", F.array().cast(wanted["issues"])), "patterns": F.when(sound, F.col("patterns")),
        "pattern_groups": F.when(sound, F.coalesce("pattern_groups", F.array().cast(wanted["pattern_groups"]))), "selection": F.lit(None),
    }
    return s.select(*[value.get(c, F.col(c)).cast(k).alias(c) for c, k in wanted.items()])
