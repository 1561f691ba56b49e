"""Registered queries of candidate generation and of delimited sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit, initialise, joint_seeds, local, prepare, seeds
from ..sources import delimited
from .inputs import EMB, FIT, embedding_cells, label_candidates, table
from .queries import query, r6

U = "('0x' || substr(md5('{seed}:' || candidate || ':' || row_index), 1, 13))::BIGINT / 4503599627370496e0"
PARTS = "m AS (SELECT DISTINCT l_suppkey % 25 AS id, l_partkey AS row_index FROM lineitem), sides AS (SELECT n_nationkey AS candidate, (n_nationkey + k) % 25 AS id, k FROM nation, range(2) t(k))"
HELD = f"{PARTS}, held AS (SELECT candidate::BIGINT AS candidate, row_index::BIGINT AS row_index, max(1 - k) AS in_a, max(k) AS in_b FROM sides JOIN m USING (id) GROUP BY ALL)"


def _parents(s, d):
    members = table(s, d, "lineitem").select((F.col("l_suppkey") % 25).cast("long").alias("id"), F.col("l_partkey").cast("long").alias("row_index")).distinct()
    n = F.col("n_nationkey").cast("long")
    return table(s, d, "nation").select(n.alias("candidate"), n.alias("a"), ((n + 1) % 25).alias("b")), members


@query("q_random_members", f"""WITH p AS (SELECT s_suppkey::BIGINT AS candidate, c_custkey::BIGINT AS row_index, s_suppkey % 5 + 2 AS size FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT candidate, row_index FROM p QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY {U.format(seed='draw-1')}, row_index) <= size""")
def _(s, d):
    candidates = table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("candidate"), F.col("s_nationkey").alias("stratum"), (F.col("s_suppkey") % 5 + 2).alias("size"))
    elements = table(s, d, "customer").select(F.col("c_nationkey").alias("stratum"), F.col("c_custkey").cast("long").alias("row_index"))
    return seeds.random_members(candidates, elements, "row_index")


@query("q_nearest_rows", f"""WITH {EMB}, anchors AS (SELECT candidate, min(row_index) AS row_index FROM crows GROUP BY candidate),
mine AS (SELECT candidate, column_index, num AS av, rr FROM cells JOIN anchors USING (row_index) JOIN ccols USING (candidate, column_index) JOIN stats USING (column_index) WHERE num IS NOT NULL),
near AS (SELECT candidate, row_index, round(avg(CASE WHEN num IS NULL THEN 1e0 WHEN rr > 1e-12 THEN least(1e0, abs(num - av) / rr) ELSE (abs(num - av) > 1e-12)::INT END), 9) AS distance
  FROM cells JOIN mine USING (column_index) GROUP BY ALL)
SELECT candidate, row_index, round(distance, 6) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY distance, row_index) <= 8""")
def _(s, d):
    cells = embedding_cells(s, d)
    rows, columns = label_candidates(s, d)
    anchors = rows.groupBy("candidate").agg(F.min("row_index").alias("row_index"))
    return r6(seeds.nearest_rows(cells, anchors, columns, prepare.column_stats(cells), 8), "distance")


@query("q_best_columns", f"WITH {FIT} SELECT candidate, column_index, round(error, 6) AS error FROM fits QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY round(error, 9), column_index) <= 3")
def _(s, d):
    cells = embedding_cells(s, d)
    rows, columns = label_candidates(s, d)
    fits = fit.constant_fit_numeric(fit.submatrix(cells, rows, columns), prepare.column_stats(cells))
    return r6(seeds.best_columns(fits, 3), "error")


for how, keep in {"union": "true", "intersection": "in_a + in_b = 2", "difference": "in_a = 1 AND in_b = 0", "symmetric": "in_a + in_b = 1"}.items():

    @query(f"q_members_{how}", f"WITH {HELD} SELECT candidate, row_index FROM held WHERE {keep}")
    def _(s, d, how=how):
        pairs, members = _parents(s, d)
        return seeds.combine(pairs, members, "row_index", how)


@query("q_crossover", f"WITH {HELD} SELECT candidate, row_index FROM held WHERE in_a + in_b = 2 OR {U.format(seed='cross-1')} < 0.5e0")
def _(s, d):
    pairs, members = _parents(s, d)
    return seeds.crossover(pairs, members, "row_index")


@query("q_half_uniform", f"WITH {HELD} SELECT candidate, row_index FROM held WHERE in_a = in_b OR (in_a = 1) <> ({U.format(seed='half-1')} < 0.5e0)")
def _(s, d):
    pairs, members = _parents(s, d)
    return seeds.half_uniform(pairs, members, "row_index")


_ONE = "('0x' || substr(md5('{seed}:' || candidate), 1, 13))::BIGINT / 4503599627370496e0"
_SIZED = f"""{HELD}, n AS (SELECT candidate, sum(in_a) AS na, sum(in_b) AS nb, count(*) AS nu FROM held GROUP BY 1),
b AS (SELECT *, greatest(2, least(na, nb)) AS lo FROM n), z AS (SELECT candidate, lo + floor({_ONE.format(seed='mix-1:size')} * (greatest(lo, least(greatest(na, nb), nu)) - lo + 1)) AS size,
  {_ONE.format(seed='mix-1:apply')} < 0.5e0 AS mixed FROM b)"""


@query("q_recombine", f"""WITH {_SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY in_a + in_b DESC, {U.format(seed='mix-1')}, row_index) AS rank FROM held JOIN z USING (candidate))
SELECT candidate, row_index FROM r WHERE CASE WHEN mixed THEN rank <= size ELSE in_a = 1 END""")
def _(s, d):
    pairs, members = _parents(s, d)
    return seeds.recombine(pairs, members, "row_index")


@query("q_recombine_by_evidence", f"""WITH {_SIZED}, w AS (SELECT *, CASE WHEN row_index % 10 < 9 THEN (row_index % 100) / 80e0 END AS loss FROM held JOIN z USING (candidate)),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY in_a + in_b DESC, -ln(1 - {U.format(seed='mix-1')}) / (0.05e0 + greatest(0, 1 - least(1, coalesce(loss, 1)))), row_index) AS rank FROM w)
SELECT candidate, row_index FROM r WHERE CASE WHEN mixed THEN rank <= size OR in_a + in_b = 2 ELSE in_a = 1 END""")
def _(s, d):
    pairs, members = _parents(s, d)
    k = F.col("row_index")
    losses = seeds.combine(pairs, members, "row_index", "union").select("candidate", k, F.when(k % 10 < 9, k % 100 / 80.0).otherwise(float("inf")).alias("loss"))
    return seeds.recombine(pairs, members, "row_index", losses=losses)


@query("q_flip", f"""WITH u AS (SELECT ((c_nationkey + k) % 25)::BIGINT AS candidate, c_custkey::BIGINT AS row_index, k = 0 AS member FROM customer, range(2) t(k))
SELECT candidate, row_index FROM u WHERE member <> ({U.format(seed='flip-1')} < 0.2e0)""")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("n"), F.col("c_custkey").cast("long").alias("row_index"))
    universe = c.select(F.explode(F.array("n", (F.col("n") + 1) % 25)).alias("candidate"), "row_index")
    return seeds.flip(c.select(F.col("n").alias("candidate"), "row_index"), universe, "row_index", 0.2)


@query("q_infer_kinds", """WITH f AS (
  SELECT 'key' AS name, c_custkey::VARCHAR AS v, 'numeric' AS kind FROM customer UNION ALL SELECT 'segment', CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END, 'categorical' FROM customer
  UNION ALL SELECT 'flag', CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 2)::VARCHAR END, 'boolean' FROM customer UNION ALL SELECT 'none', NULL, 'categorical' FROM customer)
SELECT name, any_value(kind) AS kind, count(v) AS n_observed, count(DISTINCT v) AS n_distinct FROM f GROUP BY name""")
def _(s, d):
    k = F.col("c_custkey")
    fields = table(s, d, "customer").select(
        k.cast("string").alias("key"), F.when(k % 11 != 0, F.col("c_mktsegment")).otherwise(" N/A ").alias("segment"),
        F.when(k % 5 != 0, (k % 2).cast("string")).otherwise("?").alias("flag"), F.lit("nan").alias("none"),
    )
    return delimited.infer_kinds(fields)


@query("q_identifier_faults", """WITH v AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 51 = 0 THEN ' ' ELSE o_custkey::VARCHAR END AS v FROM orders)
SELECT count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_missing, count(*) FILTER (v = ' ') AS n_blank, count(*) FILTER (v <> ' ') - count(DISTINCT v) FILTER (v <> ' ') AS n_repeated FROM v""")
def _(s, d):
    k = F.col("o_orderkey")
    v = F.when(k % 50 == 0, None).when(k % 51 == 0, " ").otherwise(F.col("o_custkey").cast("string"))
    return delimited.identifier_faults(table(s, d, "orders").select(v.alias("id")), "id")


@query("q_derived_annotations", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS st, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS c FROM orders)
SELECT o_orderkey, st = 'F' AS eq, st <> 'F' AS ne, c <= 100 AS le, st IN ('F', 'P') AS isin FROM o""")
def _(s, d):
    k = F.col("o_orderkey")
    st, c = F.when(k % 7 != 0, F.col("o_orderstatus")), F.when(k % 9 != 0, F.col("o_custkey"))
    rules = {"eq": (st, "equal", "F"), "ne": (st, "not_equal", "F"), "le": (c, "less_equal", 100), "isin": (st, "in", ["F", "P"])}
    return table(s, d, "orders").select("o_orderkey", *[delimited.derive(*r).alias(n) for n, r in rules.items()])


@query("q_mask_members", "SELECT id, column_index FROM (SELECT vec_id::BIGINT AS id, c::BIGINT AS column_index, embedding[c + 1] > 0.1e0 AS inside FROM embeddings, range(64) t(c)) WHERE inside")
def _(s, d):
    masks = table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double") > 0.1).alias("mask"))
    return delimited.mask_members(masks, "id", "mask", "column_index").withColumn("column_index", F.col("column_index").cast("long"))


def _relations(s, d):
    """The two lowest rows of each label as a pair."""
    two = table(s, d, "embeddings").groupBy(F.col("label").cast("long").alias("candidate")).agg(F.array_sort(F.collect_list(F.col("vec_id").cast("long"))).alias("v"))
    return two.select("candidate", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"), F.lit(4).alias("n_columns"), F.lit(10).alias("n_rows"))


_RELATION = """WITH {emb}, pr AS (SELECT label::BIGINT AS candidate, list_sort(list(vec_id::BIGINT)) AS v FROM embeddings GROUP BY 1),
x AS (SELECT candidate, v[1] AS first, v[2] AS second, a.column_index, {relation} AS rel, {scale} AS scale FROM pr JOIN cells a ON a.row_index = v[1] JOIN cells b ON b.row_index = v[2] AND b.column_index = a.column_index
  JOIN stats s ON s.column_index = a.column_index WHERE {usable}),
m AS (SELECT candidate, median(rel) AS m FROM x GROUP BY 1)
SELECT candidate, first, second, column_index, row_number() OVER (PARTITION BY candidate ORDER BY round(abs(rel - m) / scale, 12), column_index)::INT AS rank, round(abs(rel - m) / scale, {digits}) AS off FROM x JOIN m USING (candidate)"""


@query("q_pair_ranking_additive", _RELATION.format(emb=EMB, relation="b.num - a.num", scale="CASE WHEN rr > 1e-12 THEN rr ELSE greatest(abs(median), 1) END", usable="a.num IS NOT NULL AND b.num IS NOT NULL", digits=6))
def _(s, d):
    cells = embedding_cells(s, d)
    return r6(joint_seeds.relation_ranking(cells, _relations(s, d), prepare.column_stats(cells), "additive", pool=64), "off").drop("n_columns")


@query("q_pair_ranking_multiplicative", _RELATION.format(emb=EMB, relation="b.num / a.num", scale="1", usable="abs(a.num) > 1e-12 AND b.num IS NOT NULL", digits=5))
def _(s, d):
    cells = embedding_cells(s, d)
    out = joint_seeds.relation_ranking(cells, _relations(s, d), prepare.column_stats(cells), "multiplicative", pool=64)
    return out.withColumn("off", F.round("off", 5)).drop("n_columns")


@query("q_joint_seeds")
def _(s, d):
    """Ten additive seeds of 12 rows and 4 columns, one row a member."""
    cells = embedding_cells(s, d)
    wanted = s.range(10).select(F.col("id").alias("candidate"), F.lit(12).alias("n_rows"), F.lit(4).alias("n_columns"))
    rows, columns = joint_seeds.joint_seeds(cells, wanted, prepare.column_stats(cells), "additive")
    side = lambda df, axis, c: df.select("candidate", F.lit(axis).alias("axis"), F.col(c).cast("long").alias("member"))
    return side(rows, "row", "row_index").unionByName(side(columns, "column", "column_index"))


@query("q_next_targets", """WITH t AS (SELECT c_nationkey::BIGINT AS cell, c_custkey % 4 AS slot, count(*) % 5 AS attempts FROM customer GROUP BY 1, 2),
s AS (SELECT n_nationkey::BIGINT AS cell, k AS slot, ['constant', 'additive', 'multiplicative', 'constant'][k + 1] AS pattern, coalesce(attempts, 0) AS attempts, coalesce(attempts, 0) % 2 = 1 AS made
  FROM nation CROSS JOIN range(4) r(k) LEFT JOIN t ON t.cell = n_nationkey AND t.slot = k),
o AS (SELECT *, sum(attempts) OVER (PARTITION BY cell) AS tried FROM s),
f AS (SELECT * FROM o WHERE NOT made AND tried < 8 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY attempts, slot) = 1)
SELECT cell, slot::INT AS slot, pattern, attempts::BIGINT AS attempts FROM f ORDER BY tried, cell LIMIT 10""")
def _(s, d):
    plan = initialise.coverage_plan(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("cell")), ("constant", "additive", "multiplicative"))
    tried = table(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("cell"), (F.col("c_custkey") % 4).cast("int").alias("slot")).agg((F.count(F.lit(1)) % 5).alias("n")).filter("n > 0")
    attempts = tried.select("cell", "slot", F.explode(F.array_repeat(F.col("n") % 2 == 1, F.col("n").cast("int"))).alias("hit"))
    return initialise.next_targets(initialise.recorded(plan, attempts), 10, 8).select("cell", "slot", "pattern", "attempts")


@query("q_pattern_aware")
def _(s, d):
    """Twelve candidates of three patterns, one row a candidate: its shape as it came out."""
    cells = embedding_cells(s, d)
    bounds = s.range(1).select(F.lit(0).alias("bound"), *[F.lit(v).cast("long").alias(n) for n, v in (("min_rows", 4), ("max_rows", 30), ("min_columns", 3), ("max_columns", 8))])
    asked = initialise.pattern_requests(bounds, 12, ("constant", "additive", "multiplicative"), 4)
    return initialise.grow(cells.withColumn("code", F.lit(None).cast("int")), asked, prepare.column_stats(cells))[2]


_IDS = ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


@query("q_usable_identifiers", "SELECT unnest(['" + "', '".join(_IDS) + "']) AS name, unnest([" + ", ".join(f"count(*) = count(DISTINCT trim({c}::VARCHAR)) AND count(*) FILTER (trim({c}::VARCHAR) <> '') = count(*)" for c in _IDS) + "]) AS usable FROM orders")
def _(s, d):
    return delimited.usable_identifiers(table(s, d, "orders"), list(_IDS))


@query("q_default_identifiers", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::VARCHAR AS identifier FROM orders")
def _(s, d):
    return delimited.default_identifiers(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


@query("q_category_order", "SELECT c_mktsegment AS value, (row_number() OVER (ORDER BY min(c_custkey)) - 1)::INT AS code FROM customer GROUP BY 1")
def _(s, d):
    return delimited.category_order(table(s, d, "customer"), "c_custkey", "c_mktsegment")


_LU = "('0x' || substr(md5('local-1:{0}:' || candidate || ':' || sequence), 1, 13))::BIGINT / 4503599627370496e0"


@query("q_local_plan", f"""WITH p AS (SELECT c_custkey::BIGINT AS candidate, CASE WHEN c_custkey % 3 = 0 THEN 'initializer' ELSE 'alternating_pattern_local_search' END AS producer,
  CASE WHEN c_custkey % 2 = 0 THEN 'swap_row' ELSE 'add_column' END AS last, c_nationkey::BIGINT AS sequence, 2 + c_custkey % 4 AS n_rows, 2 + c_custkey % 3 AS n_columns FROM customer),
t AS (SELECT *, CASE WHEN producer = 'alternating_pattern_local_search' THEN CASE WHEN last = 'swap_row' THEN 'columns' ELSE 'rows' END WHEN sequence % 2 = 0 THEN 'rows' ELSE 'columns' END AS turn,
  {_LU.format('kind')} AS u, {_LU.format('way')} AS v FROM p),
s AS (SELECT *, CASE turn WHEN 'rows' THEN n_rows < 5 ELSE n_columns < 4 END AS grow, CASE turn WHEN 'rows' THEN n_rows > 2 ELSE n_columns > 2 END AS shrink FROM t)
SELECT candidate, turn AS side, CASE WHEN grow AND u >= 0.25 THEN 'swap' WHEN grow AND shrink THEN CASE WHEN v < 0.5 THEN 'add' ELSE 'remove' END WHEN grow THEN 'add' ELSE 'remove' END AS operation FROM s""")
def _(s, d):
    k = F.col("c_custkey").cast("long")
    c = table(s, d, "customer").withColumn("candidate", k)
    producer = F.when(k % 3 == 0, "initializer").otherwise(local.NAME)
    parents = c.select("candidate", producer.alias("producer"), F.when(k % 2 == 0, "swap_row").otherwise("add_column").alias("operation"), F.col("c_nationkey").cast("long").alias("sequence"))
    sizes = c.select("candidate", (k % 4 + 2).alias("n_rows"), (k % 3 + 2).alias("n_columns"), F.lit(5).alias("all_rows"), F.lit(4).alias("all_columns"))
    return local.local_plan(parents, sizes)
