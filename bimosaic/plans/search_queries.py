"""Registered queries of search, agreement and imports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, archive, fit, prepare, search, structure
from ..sources import imports
from .inputs import FIT, MEMBERS, SCORED, embedding_cells, label_candidates, memberships, scored, table
from .queries import query, r6


def _u(seed: str, *parts: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(parts) + "), 1, 13))::BIGINT / 4503599627370496e0"


CREDIT = f"""{SCORED}, credit AS (SELECT generation AS emitter, cell, count(*) AS evaluations, count(*) FILTER (violation <= 0) AS accepted, count(*) FILTER (violation <= 0 AND id % 7 = 0) AS created FROM scored GROUP BY ALL),
credits AS (SELECT *, created + 0.25e0 * (accepted - created) AS credit FROM credit)"""
SLOTS = """, slots AS (SELECT *, round(CASE WHEN evaluations + k > 0 THEN credit / (evaluations + k) + 0.5e0 * sqrt(ln(greatest(2, total + 1)::DOUBLE) / (evaluations + k)) ELSE 'inf'::DOUBLE END, 9) AS s
  FROM (SELECT *, sum(evaluations) OVER ({w}) AS total FROM stats), range({count}) t(k))
SELECT {key}emitter, count(*) AS allocated FROM (SELECT * FROM slots QUALIFY row_number() OVER ({w} ORDER BY s DESC, emitter, k) <= {count}) GROUP BY ALL"""


def _credit(s, d, *keys):
    x = scored(s, d).withColumn("emitter", F.col("generation")).withColumn("accepted", F.col("violation") <= 0).withColumn("created", (F.col("violation") <= 0) & (F.col("id") % 7 == 0))
    return search.credit(x, *keys)


@query("q_scheduler_credit", f"WITH {CREDIT} SELECT emitter, cell, evaluations, accepted, created, credit FROM credits")
def _(s, d):
    return _credit(s, d, "emitter", "cell")


@query("q_allocate_credit", f"WITH {CREDIT}, stats AS (SELECT emitter, sum(evaluations) AS evaluations, sum(credit) AS credit FROM credits GROUP BY emitter)" + SLOTS.format(w="PARTITION BY 0", count=64, key=""))
def _(s, d):
    return search.allocate_by_credit(_credit(s, d, "emitter").withColumn("position", F.col("emitter")), 64)


@query("q_allocate_credit_cell", f"WITH {CREDIT}, stats AS (SELECT * FROM credits)" + SLOTS.format(w="PARTITION BY cell", count=12, key="cell, "))
def _(s, d):
    return search.allocate_by_credit(_credit(s, d, "emitter", "cell").withColumn("position", F.col("emitter")), 12, within="cell")


@query("q_allocate_share", f"""WITH RECURSIVE {SCORED}, s AS (SELECT cell AS scheduler, generation AS emitter, [0.4e0, 0.25e0, 0.2e0, 0.1e0, 0.05e0][generation + 1] AS share, count(*) AS before FROM scored GROUP BY ALL),
r AS (SELECT 0 AS step, *, sum(before) OVER (PARTITION BY scheduler) AS total, 0::BIGINT AS allocated FROM s
  UNION ALL SELECT step + 1, scheduler, emitter, share, before, total, allocated + (row_number() OVER (PARTITION BY scheduler ORDER BY round((total + step + 1) * share - before - allocated, 9) DESC, emitter) = 1)::BIGINT FROM r WHERE step < 20)
SELECT scheduler, emitter, allocated FROM r WHERE step = 20""")
def _(s, d):
    share = F.element_at(F.array(*map(F.lit, (0.4, 0.25, 0.2, 0.1, 0.05))), (F.col("generation") + 1).cast("int"))
    x = scored(s, d).groupBy(F.col("cell").alias("scheduler"), "generation").agg(F.count(F.lit(1)).alias("before"))
    return search.allocate_by_share(x.select("scheduler", F.col("generation").alias("emitter"), F.col("generation").alias("position"), share.alias("share"), "before"), 20)


def _members(s, d):
    return scored(s, d).withColumn("loss", F.round((F.col("loss1") + F.col("loss2")) / 2, 9))


for guided, best in {True: "round((loss1 + loss2) / 2, 9), signature, id", False: "u, id"}.items():

    @query(f"q_parents_{'guided' if guided else 'drawn'}", f"""WITH {SCORED}, cells AS (SELECT cell, row_number() OVER (ORDER BY cell) AS pos FROM (SELECT DISTINCT cell FROM scored)),
asked AS (SELECT request, cell FROM (SELECT s_suppkey::BIGINT AS request, floor({_u('parent-1:cell', 's_suppkey')} * (SELECT count(*) FROM cells)) + 1 AS pos FROM supplier) JOIN cells USING (pos)),
pooled AS (SELECT *, {_u('parent-1', 'request', 'id')} AS u FROM asked JOIN scored USING (cell) QUALIFY row_number() OVER (PARTITION BY request ORDER BY u, id) <= 4)
SELECT request, id FROM pooled QUALIFY row_number() OVER (PARTITION BY request ORDER BY {best}) = 1""")
    def _(s, d, guided=guided):
        asked = table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("request"))
        return search.parents(asked, _members(s, d), 4, guided)


@query("q_mate_pool", f"""WITH {MEMBERS}, m AS (SELECT id AS b, row_number() OVER (PARTITION BY id % 5 ORDER BY id * 7 % 23, sha256(id::VARCHAR)) AS local, sha256(id::VARCHAR) AS signature FROM (SELECT DISTINCT id FROM det_rows))
SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(row_jaccard + column_jaccard, 9) DESC, local, signature)::INT AS rank FROM pairs JOIN m USING (b) QUALIFY rank <= 5""")
def _(s, d):
    m = memberships(s, d)
    pairs = structure.jaccard_pairs(m["ref_rows"], m["ref_columns"], m["det_rows"], m["det_columns"])
    members = m["det_rows"].select("id").distinct().select("id", (F.col("id") % 5).alias("cell"), (F.col("id") * 7 % 23).alias("loss"), F.sha2(F.col("id").cast("string"), 256).alias("signature"))
    return search.mate_pool(pairs.select("a", "b"), pairs, members, 5)


@query("q_least_occupied", f"""WITH {SCORED}, o AS (SELECT n_columns AS x, n_rows // 4 AS y, count(*) AS n FROM scored GROUP BY 1, 2),
t AS (SELECT i::INT AS x, j::INT AS y, coalesce(n, 0)::BIGINT AS n, ((i + j) % 3)::INT AS pattern FROM range(2, 15) u(i) CROSS JOIN range(25) v(j) LEFT JOIN o ON o.x = i AND o.y = j)
SELECT pattern, x, y, n FROM t QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY n, x, y) = 1""")
def _(s, d):
    o = scored(s, d).select(F.col("n_columns").cast("int").alias("x"), F.floor(F.col("n_rows") / 4).cast("int").alias("y"))
    targets = archive.cell_targets(o, [16, 32]).filter("x BETWEEN 2 AND 14 AND y < 25")
    return search.least_occupied(targets.withColumn("pattern", ((F.col("x") + F.col("y")) % 3).cast("int")), "pattern")


def _levels(high: str, name: str) -> str:
    steps = f"least(4, {high} - 2 + 1)"
    return f"list_distinct(list_concat([round_even(2 * power({high} / 2e0, i / greatest({steps} - 1, 1)::DOUBLE), 0)::BIGINT FOR i IN range({steps})], [2, {high}])) AS {name}"


@query("q_shapes", f"""WITH b AS (SELECT s_suppkey::BIGINT AS bound, s_suppkey % 97 + 2 AS hr, s_suppkey % 13 + 2 AS hc FROM supplier),
l AS (SELECT bound, {_levels('hr', 'r')}, {_levels('hc', 'c')} FROM b),
g AS (SELECT bound, n_rows, unnest(c) AS n_columns FROM (SELECT bound, c, unnest(r) AS n_rows FROM l)),
q AS (SELECT *, row_number() OVER (PARTITION BY bound ORDER BY round, {_u('shape-1', 'bound', 'round', 'n_rows', 'n_columns')}, n_rows, n_columns) - 1 AS candidate FROM g, range(12) t(round))
SELECT bound, candidate::INT AS candidate, n_rows, n_columns FROM q WHERE candidate < 12""")
def _(s, d):
    k = F.col("s_suppkey").cast("long")
    bounds = table(s, d, "supplier").select(k.alias("bound"), F.lit(2).alias("min_rows"), (k % 97 + 2).alias("max_rows"), F.lit(2).alias("min_columns"), (k % 13 + 2).alias("max_columns"))
    return search.shapes(bounds, 12, 4)


@query("q_row_compatibility", f"""WITH {FIT}, x AS (SELECT candidate, row_index, column_index, num, parameter, rr, CASE WHEN rr > 1e-12 THEN rr ELSE greatest(abs(stats.median), 1) END AS scale, (column_index // 10) % 2 AS joint
  FROM inside JOIN par USING (candidate, column_index) JOIN stats USING (column_index)),
e AS (SELECT candidate, row_index, median(num - parameter) AS effect FROM x WHERE joint = 1 AND num IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT candidate, row_index, round(coalesce(avg(CASE WHEN joint = 1 THEN least(1, abs(num - effect - parameter) / scale) + 0 * effect WHEN rr > 1e-12 THEN least(1, abs(num - parameter) / rr) ELSE (abs(num - parameter) > 1e-12)::INT + 0 * num END) FILTER (num IS NOT NULL AND (joint = 0 OR effect IS NOT NULL)), 'inf'::DOUBLE), 6) AS score
FROM x LEFT JOIN e USING (candidate, row_index) GROUP BY ALL""")
def _(s, d):
    cells = embedding_cells(s, d)
    rows, columns = label_candidates(s, d)
    stats = prepare.column_stats(cells)
    pattern = F.when(F.floor(F.col("column_index") / 10) % 2 == 0, "constant").otherwise("additive")
    fits = fit.constant_fit_numeric(fit.submatrix(cells, rows, columns), stats).select("candidate", "column_index", pattern.alias("pattern"), "parameter")
    return r6(search.row_compatibility(cells, rows, fits, stats), "score")


@query("q_evidence_deficit", "SELECT l_suppkey, l_linenumber, round(greatest(e, least(1e0, greatest(0e0, (0.1e0 - (r - e)) / 0.1e0))), 6) AS error FROM (SELECT l_suppkey, l_linenumber, avg(l_discount) AS e, avg(l_tax) * 2 AS r FROM lineitem GROUP BY ALL)")
def _(s, d):
    x = table(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("e"), (F.avg("l_tax") * 2).alias("r"))
    return r6(x.select("l_suppkey", "l_linenumber", search.evidence_deficit(F.col("e"), F.col("r"), 0.1).alias("error")), "error")


@query("q_model_margins", """WITH m AS (SELECT l_suppkey AS candidate, l_linenumber AS column_index, l_returnflag AS pattern, round(avg(l_discount), 2) AS error, l_returnflag = 'N' AS chosen FROM lineitem GROUP BY ALL)
SELECT a.candidate, a.column_index, round(min(b.error) - a.error, 6) AS margin,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT unnest(list_distinct(list_append(coalesce(list(b.pattern) FILTER (abs(b.error - a.error) <= 1e-12), []), 'N'))) AS v)) AS equivalents, count(*) FILTER (abs(b.error - a.error) <= 1e-12) > 0 AS ambiguous
FROM m a JOIN m b ON a.candidate = b.candidate AND a.column_index = b.column_index AND a.chosen AND NOT b.chosen GROUP BY a.candidate, a.column_index, a.error""")
def _(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("candidate"), F.col("l_linenumber").alias("column_index"), F.col("l_returnflag").alias("pattern")).agg(F.round(F.round(F.avg("l_discount"), 12), 2).alias("error"))  # ties decided whatever the order of addition
    return r6(search.model_margins(x.withColumn("chosen", F.col("pattern") == "N")), "margin")


@query("q_pattern_stability", f"""WITH {MEMBERS}, c AS (SELECT a.id AS a, b.id AS b, avg(((a.id + column_index) % 3 = (b.id * 2 + column_index) % 3)::INT) AS concordance FROM ref_columns a JOIN det_columns b USING (column_index) GROUP BY 1, 2)
SELECT a, b, round(similarity * concordance, 6) AS score FROM pairs JOIN c USING (a, b)""")
def _(s, d):
    m = memberships(s, d)
    pairs = structure.jaccard_pairs(m["ref_rows"], m["ref_columns"], m["det_rows"], m["det_columns"])
    ref, det = (m[f"{n}_columns"].withColumn("pattern", (F.col("id") * k + F.col("column_index")) % 3) for n, k in (("ref", 1), ("det", 2)))
    return r6(agreement.stability(pairs, agreement.pattern_concordance(ref, det)), "score")


def _ranked(name: str, source: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_u('control-1:' + name, 'id', 'row_index')}, row_index) AS rank FROM {source} JOIN size USING (id))"


@query("q_controls", f"""WITH u AS (SELECT c_nationkey::BIGINT AS id, c_custkey::BIGINT AS row_index FROM customer), t AS (SELECT * FROM u WHERE row_index % 3 = 0),
size AS (SELECT id, count(*) AS n, greatest(1, ceil(count(*) * 0.2e0)) AS k FROM t GROUP BY id), o AS (SELECT * FROM u ANTI JOIN t USING (id, row_index)), grown AS (SELECT * FROM {_ranked('added', 'o')} WHERE rank <= k)
SELECT id, 'RANDOM_MATCHED' AS control, row_index FROM {_ranked('matched', 'u')} WHERE rank <= n
UNION ALL SELECT id, 'REMOVED', row_index FROM {_ranked('removed', 't')} WHERE n > 1 AND rank > least(n - 1, k)
UNION ALL SELECT id, 'ADDED', row_index FROM grown UNION ALL SELECT id, 'ADDED', row_index FROM t SEMI JOIN grown USING (id)""")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("id"), F.col("c_custkey").cast("long").alias("row_index"))
    return agreement.controls(c.filter("row_index % 3 = 0"), c, "row_index")


@query("q_alignment", f"""WITH {SCORED}, f AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY id) AS k FROM scored),
v AS (SELECT cell AS truth, 'coherence' AS objective, true AS less, k, id, violation <= 0 AS valid, coherence AS value FROM f UNION ALL SELECT cell, 'contrast', false, k, id, violation <= 0, contrast FROM f),
x AS (SELECT v.truth, v.objective, 'C' || (v.id % 3) AS control, v.value, CASE WHEN v.less THEN v.value - o.value ELSE o.value - v.value END AS better FROM v JOIN v o ON o.k = 1 AND v.k > 1 AND v.truth = o.truth AND v.objective = o.objective WHERE v.valid)
SELECT truth, objective, control, count(*) AS n, round(median(value), 12) AS median, round(avg((better >= 0)::INT), 12) AS favorable, round(avg(better), 12) AS improvement FROM x GROUP BY ALL""")
def _(s, d):
    x = scored(s, d)
    first = x.groupBy("cell").agg(F.min("id").alias("first"))
    x = x.join(first, "cell").withColumn("control", F.when(F.col("id") == F.col("first"), "GROUND_TRUTH").otherwise(F.concat(F.lit("C"), F.col("id") % 3)))
    parts = F.explode(F.array(F.struct(F.lit("coherence").alias("objective"), F.lit("MINIMIZE").alias("direction"), F.col("coherence").alias("value")), F.struct(F.lit("contrast").alias("objective"), F.lit("MAXIMIZE").alias("direction"), F.col("contrast").alias("value"))))
    records = x.select(F.col("cell").alias("truth"), "control", (F.col("violation") <= 0).alias("valid"), parts.alias("o")).select("truth", "control", "valid", "o.*")
    return agreement.alignment(records).withColumns({c: F.round(c, 12) for c in ("median", "favorable", "improvement")})


@query("q_evaluable", """WITH a AS (SELECT 'balance' AS annotation, c_custkey AS row_index, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS value, NULL AS event FROM customer
  UNION ALL SELECT 'rare', c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 1 END, NULL FROM customer UNION ALL SELECT 'time', c_custkey, c_custkey, c_custkey % 400 = 0 FROM customer),
t AS (SELECT annotation, count(value) AS n, count(*) FILTER (event) AS events, count(event) AS timed FROM a GROUP BY 1),
m AS (SELECT c_nationkey AS id, annotation, count(value) AS members FROM customer JOIN a ON c_custkey = row_index GROUP BY ALL)
SELECT id::BIGINT AS id, annotation, members, n - members AS nonmembers,
  CASE WHEN members < 10 THEN 'insufficient_members' WHEN n - members < 20 THEN 'insufficient_nonmembers' WHEN timed > 0 AND events < 10 THEN 'insufficient_events' END AS reason FROM m JOIN t USING (annotation)""")
def _(s, d):
    k = F.col("c_custkey").cast("long")
    c = table(s, d, "customer")
    none, rows = F.lit(None).cast("boolean"), c.select(F.col("c_nationkey").cast("long").alias("id"), k.alias("row_index"))
    a = c.select(F.lit("balance").alias("annotation"), k.alias("row_index"), F.when(k % 13 != 0, F.col("c_acctbal")).alias("value"), none.alias("event"))
    a = a.unionByName(c.select(F.lit("rare").alias("annotation"), k.alias("row_index"), F.when(k % 5 == 0, 1.0).alias("value"), none.alias("event")))
    a = a.unionByName(c.select(F.lit("time").alias("annotation"), k.alias("row_index"), k.cast("double").alias("value"), (k % 400 == 0).alias("event")))
    return agreement.evaluable(rows, a, rows)


@query("q_largest_good")
def _(s, d):
    x = scored(s, d).select("id", (F.lit(1e6) / (F.col("id") + 1)).alias("area"), F.round("contrast", 1).alias("u1"), F.round(1 - F.col("coherence"), 1).alias("u2"))
    parents = x.select(F.col("id").alias("inner"), F.floor(F.col("id") / 4).alias("parent")).filter("parent > 0")
    out = agreement.largest_good(x, parents, ["u1", "u2"], 0.5, 0.6)
    return r6(out, "degradation")


@query("q_search")
def _(s, d):
    return search.search(embedding_cells(s, d))


_DOCS = "WITH b AS (SELECT DISTINCT l_suppkey % 10 AS source, l_orderkey % 7 AS k, l_linenumber AS row_index, (l_linenumber * 3 + l_orderkey) % 5 AS column_index FROM lineitem)"


def _coordinates(s, d):
    b = table(s, d, "lineitem").select((F.col("l_suppkey") % 10).alias("source"), (F.col("l_orderkey") % 7).alias("k"), F.col("l_linenumber").cast("long").alias("r"), ((F.col("l_linenumber") * 3 + F.col("l_orderkey")) % 5).alias("c"))
    b = b.groupBy("source", "k").agg(F.collect_set("r").alias("rows"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.array_contains(F.collect_set("c"), i.cast("long"))).alias("columns"))
    docs = b.groupBy("source").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "rows", "columns"))), lambda e: F.struct(e["rows"].alias("rows"), e["columns"].alias("columns")))).alias("json"))
    return imports.coordinate_sets(docs, "OTHER_TOOL"), docs.select("source", F.lit(8).alias("rows"), F.lit(5).alias("columns"))


for side, element in {"rows": "row_index", "columns": "column_index"}.items():

    @query(f"q_import_{side}", f"{_DOCS} SELECT DISTINCT source, 'other-tool-' || lpad((dense_rank() OVER (PARTITION BY source ORDER BY k) - 1)::VARCHAR, 6, '0') AS id, {element}::BIGINT AS {element} FROM b")
    def _(s, d, side=side, element=element):
        sets, bounds = _coordinates(s, d)
        return imports.members(sets, bounds, side, element)


@query("q_import_planted", """WITH n AS (SELECT n_regionkey AS source, 'b' || n_nationkey AS id, n_nationkey FROM nation)
SELECT source, id, CASE WHEN n_nationkey % 2 = 0 THEN 'numeric' ELSE 'mixed' END AS kind, n_nationkey::VARCHAR || ',' || (n_nationkey + 3) AS rows, CASE WHEN n_nationkey % 2 = 0 THEN '0,1' ELSE '1,5' END AS columns,
  CASE WHEN n_nationkey % 2 = 0 THEN 'Additive' END AS pattern, n_nationkey + 0.5e0 AS noise FROM n""")
def _(s, d):
    k = F.col("n_nationkey").cast("long")
    even, none = k % 2 == 0, F.lit(None)
    one = F.struct(
        F.when(even, "Numeric").otherwise("Mixed").alias("Type"), F.when(even, F.array(k + 3, k)).alias("X"), F.when(even, F.array(F.lit(1), F.lit(0))).alias("Y"), F.when(even, none).otherwise(F.array(k, k + 3)).alias("Rows"),
        F.when(even, none).otherwise(F.array(F.lit(1))).alias("NumericColumns"), F.when(even, none).otherwise(F.array(F.lit(5))).alias("SymbolicColumns"), F.when(even, "Additive").alias("RowPattern"), F.concat(k.cast("string"), F.lit(",5")).alias("%Noise"),
    )
    entries = table(s, d, "nation").select(F.col("n_regionkey").alias("source"), F.concat(F.lit("b"), k.cast("string")).alias("id"), one.alias("b"))
    docs = entries.groupBy("source").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("id", "b"))).alias("biclusters"))).alias("json"))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return imports.planted(docs).select("source", "id", "kind", text("rows"), text("columns"), "pattern", "noise")
