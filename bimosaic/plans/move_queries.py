"""Registered queries of membership moves, column groups and run metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit, grouping, moves, prepare
from ..streaming import observers
from ..sources import bundle
from . import results
from .inputs import CUST, EMB, MEMBERS, SCORED, customer_cells, embedding_cells, label_candidates, memberships, scored, table
from .queries import query, r6

U = "('0x' || substr(md5('{seed}:' || candidate || ':' || {part}), 1, 13))::BIGINT / 4503599627370496e0"


def _sides(s, d, side):
    m = memberships(s, d)
    if side == "row":
        return m["det_rows"].withColumnRenamed("id", "candidate"), table(s, d, "customer").select(F.col("c_custkey").alias("row_index")), "row_index"
    twelve = s.range(12).select(F.col("id").cast("int").alias("column_index"))
    return m["det_columns"].withColumnRenamed("id", "candidate").withColumn("column_index", F.col("column_index").cast("long")), twelve, "column_index"


def _move_sql(side: str, operation: str) -> str:
    e = f"{side}_index"
    universe = "SELECT c_custkey::BIGINT AS e FROM customer" if side == "row" else "SELECT c::BIGINT AS e FROM range(12) t(c)"
    rule = "held > 2" if operation == "remove" else "held < n"
    out = f"""WITH {MEMBERS}, universe AS ({universe}), m AS (SELECT id AS candidate, {e}::BIGINT AS e FROM det_{side}s), total AS (SELECT count(*) AS n FROM universe),
size AS (SELECT candidate, count(*) AS held, any_value(n) AS n FROM m, total GROUP BY candidate), parents AS (SELECT * FROM size WHERE {rule}),
gone AS (SELECT candidate, e FROM m QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY {U.format(seed='move-1', part='e')}, e) = 1),
free AS (SELECT candidate, universe.e, row_number() OVER (PARTITION BY candidate ORDER BY universe.e) - 1 AS k FROM universe, size WHERE (candidate, universe.e) NOT IN (SELECT (candidate, e) FROM m)),
new AS (SELECT candidate, e FROM free JOIN size USING (candidate) WHERE k = floor({U.format(seed='move-1', part='0')} * (n - held)))
SELECT candidate, e AS {e} FROM m SEMI JOIN parents USING (candidate)"""
    if operation != "add":
        out += " ANTI JOIN gone USING (candidate, e)"
    return out if operation == "remove" else out + f" UNION ALL SELECT candidate, e AS {e} FROM new SEMI JOIN parents USING (candidate)"


for side in ("row", "column"):
    for operation in moves.OPERATIONS:

        @query(f"q_move_{operation}_{side}", _move_sql(side, operation))
        def _(s, d, side=side, operation=operation):
            members, universe, e = _sides(s, d, side)
            return moves.random_move(members, universe, e, operation).select("candidate", F.col(e).cast("long").alias(e))


COMPATIBLE = EMB + """,
others AS (SELECT k AS candidate, c::INT AS column_index FROM range(10) u(k), range(64) t(c) WHERE c % 10 <> k),
beta AS (SELECT candidate, column_index, median(num) AS beta FROM inside GROUP BY ALL),
alpha AS (SELECT candidate, row_index, median(num - beta) AS alpha FROM inside JOIN beta USING (candidate, column_index) GROUP BY ALL HAVING count(num) >= greatest(2, ceil(count(*) * 0.8e0))),
scale AS (SELECT column_index, rr, CASE WHEN rr > 1e-12 THEN rr ELSE greatest(abs(median), 1) END AS scale FROM stats),
x AS (SELECT candidate, row_index, column_index, num, rr, scale FROM cells JOIN others USING (column_index) JOIN crows USING (candidate, row_index) JOIN scale USING (column_index)),
ok AS (SELECT candidate, column_index, median(num) AS middle FROM x GROUP BY ALL HAVING count(num) >= greatest(2, ceil(count(*) * 0.8e0))),
flat AS (SELECT candidate, column_index, avg(CASE WHEN rr > 1e-12 THEN least(1e0, abs(num - middle) / rr) ELSE (abs(num - middle) > 1e-12)::INT END) AS loss FROM x JOIN ok USING (candidate, column_index) WHERE num IS NOT NULL GROUP BY ALL),
y AS (SELECT candidate, column_index, num, scale, pattern, alpha FROM x SEMI JOIN ok USING (candidate, column_index) JOIN (SELECT candidate, row_index, 'additive' AS pattern, alpha FROM alpha
  UNION ALL SELECT candidate, row_index, 'multiplicative', alpha FROM alpha WHERE abs(alpha) > 1e-12) USING (candidate, row_index) WHERE num IS NOT NULL),
b AS (SELECT candidate, column_index, pattern, median(CASE pattern WHEN 'additive' THEN num - alpha ELSE num / scale / alpha END) AS b FROM y GROUP BY ALL HAVING count(*) >= 2),
joint AS (SELECT candidate, column_index, least(1e0, avg(CASE pattern WHEN 'additive' THEN abs(num - alpha - b) / scale ELSE abs(num / scale - alpha * b) END)) AS loss FROM y JOIN b USING (candidate, column_index, pattern) GROUP BY candidate, column_index, pattern),
fitting AS (SELECT candidate, column_index, min(loss) AS loss FROM (SELECT * FROM flat UNION ALL SELECT * FROM joint) GROUP BY ALL)
"""


def _columns(s, d):
    cells = embedding_cells(s, d)
    rows, columns = label_candidates(s, d)
    stats = prepare.column_stats(cells)
    inside = fit.submatrix(cells, rows, columns)
    alpha = fit.additive_row_effects(cells.join(rows.select("row_index").distinct(), "row_index", "left_semi"), columns, fit.column_medians(inside)).join(rows, ["candidate", "row_index"], "left_semi")
    effects = alpha.select("*", F.explode(F.array(F.lit("additive"), F.lit("multiplicative"))).alias("pattern"))
    return cells, rows, columns, stats, effects, s.range(64).select(F.col("id").cast("int").alias("column_index"))


@query("q_column_compatibility", f"WITH {COMPATIBLE} SELECT candidate, column_index, round(loss, 6) AS loss FROM fitting")
def _(s, d):
    cells, rows, columns, stats, effects, every = _columns(s, d)
    free = moves.outside(columns, every, "column_index")
    return r6(moves.column_compatibility(cells, rows, free, stats, effects).select("candidate", F.col("column_index").cast("int").alias("column_index"), "loss"), "loss")


@query("q_guided_add_column", f"""WITH {COMPATIBLE}, best AS (SELECT candidate, column_index FROM fitting QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY loss, column_index) = 1)
SELECT candidate, column_index::BIGINT AS column_index FROM ccols UNION ALL SELECT candidate, column_index FROM best""")
def _(s, d):
    cells, rows, columns, stats, effects, every = _columns(s, d)
    loss = lambda pool: moves.column_compatibility(cells, rows, pool, stats, effects)
    return moves.guided_move(columns, every, "column_index", "add", loss).select("candidate", F.col("column_index").cast("long").alias("column_index"))


@query("q_guided_remove_row", f"""WITH {EMB}, p AS (SELECT candidate, column_index, median(num) AS p FROM inside GROUP BY ALL),
loss AS (SELECT candidate, row_index, coalesce(round(avg(abs(num - p)), 9), 0) AS loss FROM inside JOIN p USING (candidate, column_index) GROUP BY ALL),
gone AS (SELECT candidate, row_index FROM loss QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY loss DESC, row_index DESC) = 1)
SELECT candidate, row_index FROM crows ANTI JOIN gone USING (candidate, row_index)""")
def _(s, d):
    cells = embedding_cells(s, d)
    rows, columns = label_candidates(s, d)
    inside = fit.submatrix(cells, rows, columns)
    x = inside.join(fit.column_medians(inside), ["candidate", "column_index"]).groupBy("candidate", "row_index").agg(F.round(F.avg(F.abs(F.col("num") - F.col("beta"))), 9).alias("loss"))
    return moves.guided_move(rows, cells.select("row_index").distinct(), "row_index", "remove", lambda pool: x, pool=1 << 30)


PROFILES = EMB + """,
mid AS (SELECT candidate, column_index, median(num) AS m FROM inside GROUP BY ALL),
prof AS (SELECT candidate, row_index, column_index, num - m AS p, CASE WHEN rr > 1e-12 THEN rr ELSE greatest(abs(median), 1) END AS scale FROM inside JOIN mid USING (candidate, column_index) JOIN stats USING (column_index)),
need AS (SELECT candidate, greatest(2, ceil(count(DISTINCT row_index) * 0.8e0)) AS required FROM prof GROUP BY candidate),
first AS (SELECT candidate, column_index AS anchor FROM (SELECT candidate, column_index, count(p) AS n FROM prof GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY n DESC, column_index) = 1),
dist AS (SELECT a.candidate, a.column_index AS anchor, b.column_index, CASE WHEN a.column_index = b.column_index THEN 0e0 WHEN count(a.p + b.p) >= any_value(required) THEN round(avg(least(1e0, abs(a.p - b.p) / greatest(a.scale, b.scale))) FILTER (a.p + b.p IS NOT NULL), 12) END AS distance
  FROM prof a JOIN prof b USING (candidate, row_index) JOIN need USING (candidate) GROUP BY a.candidate, a.column_index, b.column_index)"""


@query("q_anchor_distances", f"""WITH {PROFILES}, near AS (SELECT candidate, dist.column_index, distance FROM dist JOIN first USING (candidate, anchor)),
second AS (SELECT candidate, column_index AS anchor FROM near WHERE distance > 1e-12 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY distance DESC, column_index) = 1)
SELECT candidate, anchor, column_index, round(distance, 6) AS distance FROM dist SEMI JOIN (SELECT * FROM first UNION ALL SELECT * FROM second) USING (candidate, anchor)""")
def _(s, d):
    cells = embedding_cells(s, d)
    inside = fit.submatrix(cells, *label_candidates(s, d))
    return r6(grouping.anchor_distances(grouping.additive_profiles(inside, prepare.column_stats(cells)), anchors=2), "distance")


@query("q_largest_gap", f"""WITH {PROFILES}, o AS (SELECT candidate, anchor, column_index, distance, row_number() OVER w AS place, distance - lag(distance) OVER w AS gap, count(*) OVER (PARTITION BY candidate, anchor) AS n
  FROM dist WHERE distance IS NOT NULL WINDOW w AS (PARTITION BY candidate, anchor ORDER BY distance, column_index)),
g AS (SELECT candidate, anchor, place - 1 AS cut FROM o WHERE place > 2 AND gap > 1e-12 QUALIFY row_number() OVER (PARTITION BY candidate, anchor ORDER BY gap DESC, place) = 1)
SELECT candidate, anchor, column_index, place, coalesce(cut, n)::INT AS cut FROM o LEFT JOIN g USING (candidate, anchor) SEMI JOIN first USING (candidate, anchor) WHERE n >= 2""")
def _(s, d):
    cells = embedding_cells(s, d)
    inside = fit.submatrix(cells, *label_candidates(s, d))
    return grouping.largest_gap(grouping.anchor_distances(grouping.additive_profiles(inside, prepare.column_stats(cells)), anchors=1))


@query("q_column_groups")
def _(s, d):
    cells = embedding_cells(s, d)
    inside = fit.submatrix(cells, *label_candidates(s, d))
    return grouping.proposals(grouping.anchor_distances(grouping.multiplicative_profiles(inside, prepare.column_stats(cells)), either_sign=True))


EVERY = 100
SIX = "min(value), quantile_cont(value, 0.25), quantile_cont(value, 0.5), avg(value), quantile_cont(value, 0.75), max(value)"


def _six(source: str, prefix: str) -> str:
    return f"""SELECT "window", '{prefix}.' || name || '.' || statistic AS metric, round(value, 6) AS value FROM (SELECT "window", name,
  unnest(['minimum', 'first_quartile', 'median', 'mean', 'third_quartile', 'maximum']) AS statistic, unnest([{SIX}]) AS value FROM (SELECT "window", name, value::DOUBLE AS value FROM {source}) GROUP BY "window", name)"""


def _values(s, d):
    x = scored(s, d).select("id", F.col("id").alias("step"), *[F.col(c).cast("double").alias(c) for c in ("coherence", "contrast")])
    return x.unpivot(["id", "step"], ["coherence", "contrast"], "name", "value")


VALUES = f"{SCORED}, v AS (SELECT id, (id // {EVERY} + 1)::BIGINT AS \"window\", unnest(['coherence', 'contrast']) AS name, unnest([coherence, contrast]) AS value FROM scored)"


@query("q_objective_distribution", f"WITH {VALUES} {_six('v', 'objective')}")
def _(s, d):
    return r6(observers.evaluated(_values(s, d), EVERY, "objective"), "value")


@query("q_evaluation_issues", f"""WITH {SCORED}, e AS (SELECT (id // {EVERY} + 1)::BIGINT AS "window", violation > 0 AS a, coherence > 0.7e0 AS b FROM scored)
SELECT "window", metric, round(value, 6) AS value FROM (SELECT "window", unnest(['evaluation.valid_rate', 'evaluation.invalid_rate', 'evaluation.issue.violated.candidate_rate', 'evaluation.issue.incoherent.candidate_rate']) AS metric,
  unnest([avg((NOT a AND NOT b)::INT), avg((a OR b)::INT), nullif(avg(a::INT), 0), nullif(avg(b::INT), 0)]) AS value FROM e GROUP BY "window") WHERE value IS NOT NULL""")
def _(s, d):
    found = F.array_compact(F.array(F.when(F.col("violation") > 0, "VIOLATED"), F.when(F.col("coherence") > 0.7, "INCOHERENT")))
    return r6(observers.issues(scored(s, d).select(F.col("id").alias("step"), found.alias("issues")), EVERY), "value")


def _outcomes(s, d):
    k = F.col("id")
    status = F.when(F.col("violation") > 0, "REJECTED_INVALID").when(k % 3 == 0, "INSERTED_WITH_EVICTIONS").otherwise("INSERTED")
    gone = F.when(k % 3 == 0, F.array(k - 130)).otherwise(F.array().cast("array<bigint>"))
    return scored(s, d).select("id", k.alias("step"), F.when(k % 17 > 0, F.col("cell")).alias("cell"), status.alias("status"), gone.alias("evicted"))


OUTCOMES = f"""{VALUES}, o AS (SELECT id, id AS step, (id // {EVERY} + 1)::BIGINT AS "window", CASE WHEN id % 17 > 0 THEN cell END AS cell, violation <= 0 AS kept, CASE WHEN id % 3 = 0 THEN id - 130 END AS evicted FROM scored),
w AS (SELECT "window", max(step) AS ending FROM o GROUP BY ALL), i AS (SELECT * FROM o WHERE kept AND cell IS NOT NULL),
here AS (SELECT w."window", i.id, i.cell FROM i LEFT JOIN (SELECT evicted, min("window") AS gone FROM i GROUP BY evicted) g ON g.evicted = i.id JOIN w ON w."window" >= i."window" AND (gone IS NULL OR w."window" < gone)),
cells AS (SELECT DISTINCT cell FROM o WHERE cell IS NOT NULL),
c AS (SELECT w."window", o.cell, count(*) AS attempts, count(*) FILTER (kept) AS accepted, count(evicted) FILTER (kept) AS evictions, any_value(ending) - coalesce(max(step) FILTER (kept), 0) AS stagnation
  FROM w JOIN o ON o."window" <= w."window" WHERE o.cell IS NOT NULL GROUP BY ALL)"""


@query("q_archive_distribution", f"""WITH {OUTCOMES}, a AS (SELECT here."window", name, value FROM here JOIN v USING (id)), z AS (SELECT "window", 'members' AS name, count(*) AS value FROM here GROUP BY "window", cell)
{_six('a', 'archive_descriptor')} UNION ALL {_six('z', 'archive_cell')}""")
def _(s, d):
    return r6(observers.archive_distributions(_outcomes(s, d), _values(s, d).select("id", "name", "value"), EVERY), "value")


@query("q_cell_diagnostics", f'WITH {OUTCOMES} SELECT "window", cell, attempts, accepted, round(accepted / attempts::DOUBLE, 6) AS acceptance_ratio, evictions, stagnation FROM c')
def _(s, d):
    return r6(observers.cell_diagnostics(_outcomes(s, d), EVERY), "acceptance_ratio")


@query("q_archive_diagnostics", f"""WITH {OUTCOMES}, l AS (SELECT "window", unnest(['cell_attempts', 'cell_acceptance_ratio', 'cell_stagnation_evaluations']) AS name, unnest([attempts::DOUBLE, accepted / attempts::DOUBLE, stagnation::DOUBLE]) AS value FROM c)
{_six('l', 'qd')} UNION ALL SELECT "window", 'qd.visited_cells', count(*)::DOUBLE FROM c GROUP BY "window"
UNION ALL SELECT w."window", 'qd.unmapped_attempts', count(*) FILTER (o.cell IS NULL)::DOUBLE FROM w JOIN o ON o."window" <= w."window" GROUP BY w."window" """)
def _(s, d):
    return r6(observers.archive_diagnostics(_outcomes(s, d), EVERY), "value")


# stored results


@query("q_in_scope", "SELECT DISTINCT o_custkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND o_orderstatus = 'P')")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("pattern"))
    return results.in_scope(o.select("id").distinct(), o, ["F", "O"])


@query("q_source_columns", "SELECT DISTINCT l_suppkey AS id, l_linenumber // 2 AS column_index FROM lineitem")
def _(s, d):
    m = table(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("column_index"))
    columns = m.select("column_index").distinct().withColumn("source_column_index", F.floor(F.col("column_index") / 2))
    return results.source_columns(m, columns)


@query("q_subsample", f"WITH {CUST} SELECT row_index, column_index, num, code FROM cells SEMI JOIN (SELECT o_custkey AS row_index FROM orders) USING (row_index)")
def _(s, d):
    return results.subsample(customer_cells(s, d), table(s, d, "orders").select(F.col("o_custkey").alias("row_index")))[0].select("row_index", "column_index", "num", "code")


@query("q_spread_sample", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders))
SELECT o_orderkey FROM r SEMI JOIN (SELECT DISTINCT floor(j * ((n - 1) / 127e0))::BIGINT AS k FROM range(128) t(j), (SELECT any_value(n) AS n FROM r)) USING (k)""")
def _(s, d):
    return results.spread_sample(table(s, d, "orders").select("o_orderkey").distinct(), "o_orderkey", 128)


@query("q_composition", """WITH c AS (SELECT l_orderkey AS candidate, ['constant', 'additive', 'multiplicative'][l_suppkey % 4 + 1] AS pattern, l_returnflag = 'R' AS derived FROM lineitem)
SELECT candidate, count(*) AS columns, count(*) FILTER (pattern = 'constant') AS constant_columns, count(*) FILTER (pattern = 'additive') AS additive_columns, count(*) FILTER (pattern = 'multiplicative') AS multiplicative_columns,
  count(DISTINCT pattern) AS patterns, count(*) FILTER (derived) AS indicators, round(avg(derived::INT), 6) AS indicator_share FROM c GROUP BY candidate""")
def _(s, d):
    pattern = F.try_element_at(F.array(*map(F.lit, results.PATTERNS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    derived = F.when(F.col("l_returnflag") == "R", "missingness_indicators")
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("column_index"), pattern.alias("pattern"), derived.alias("derivation"))
    return r6(results.composition(x), "indicator_share")


@query("q_coverage_gaps", """WITH p AS (SELECT DISTINCT o_orderpriority AS algorithm, o_custkey AS dataset FROM orders)
SELECT dataset, count(*) AS covered, (SELECT count(DISTINCT algorithm) FROM p) AS algorithms FROM p GROUP BY dataset HAVING count(*) < (SELECT count(DISTINCT algorithm) FROM p)""")
def _(s, d):
    return results.coverage_gaps(table(s, d, "orders").select(F.col("o_orderpriority").alias("algorithm"), F.col("o_custkey").alias("dataset")), "algorithm", "dataset")


@query("q_select_each", f"""WITH {SCORED}, a AS (SELECT 'coherent' AS selector, row_number() OVER (ORDER BY coherence, signature, id) AS rank, id FROM scored WHERE violation <= 0 QUALIFY rank <= 25),
b AS (SELECT 'contrasting' AS selector, row_number() OVER (ORDER BY contrast DESC, signature, id) AS rank, id FROM scored WHERE coherence <= 0.5e0 QUALIFY rank <= 40) SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(s, d):
    last = [F.col("signature"), F.col("id")]
    both = {"coherent": (F.col("violation") <= 0, [F.col("coherence"), *last], 25), "contrasting": (F.col("coherence") <= 0.5, [F.desc("contrast"), *last], 40)}
    return results.select_each(scored(s, d).select("id", "coherence", "contrast", "violation", "signature"), both).select("selector", "rank", "id")


@query("q_summaries", """WITH o AS (SELECT o_custkey AS id, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS patterns FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, patterns FROM customer LEFT JOIN o ON id = c_custkey""")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "id")
    named = o.groupBy("id").agg(F.avg("o_totalprice").alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")).unpivot("id", ["mean", "low", "high"], "name", "value")
    kind = F.when(F.col("name") == "mean", "objective").when(F.col("name") == "low", "constraint").otherwise("descriptor")
    out = results.summaries(table(s, d, "customer").select(F.col("c_custkey").alias("id")), named.withColumn("kind", kind), o.select("id", F.col("o_orderstatus").alias("pattern")))
    return r6(out.select("id", F.col("objectives")["mean"].alias("mean"), F.col("constraints")["low"].alias("low"), F.col("descriptors")["high"].alias("high"), F.array_join("patterns", ",").alias("patterns")), "mean", "low", "high")


@query("q_replicate", "SELECT c_custkey, regexp_replace(n, '_[0-9]+$', '') AS family, nullif(regexp_extract(n, '_([0-9]+)$', 1), '')::BIGINT AS replicate FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 3 > 0 THEN '_' || c_custkey % 7 ELSE '' END AS n FROM customer)")
def _(s, d):
    k = F.col("c_custkey")
    name = F.concat("c_mktsegment", F.when(k % 3 > 0, F.concat(F.lit("_"), k % 7)).otherwise(""))
    return results.replicate(table(s, d, "customer").select("c_custkey", name.alias("dataset"))).drop("dataset")


@query("q_feasible_shapes", """WITH s AS (SELECT l_suppkey AS column_index, count(*) AS support FROM lineitem GROUP BY ALL),
w AS (SELECT c_custkey AS shape, c_custkey % 900 + 2 AS rows, 3 + c_custkey % 40 AS min_rows, 60 + c_custkey % 700 AS max_rows, c_nationkey + 1 AS columns, 1 + c_custkey % 9 AS min_columns, 4 + c_custkey % 12 AS max_columns FROM customer),
b AS (SELECT *, least(greatest(rows, min_rows), max_rows) AS bounded FROM w WHERE min_rows <= max_rows AND min_columns <= max_columns),
r AS (SELECT n, (SELECT count(*) FROM s WHERE support >= greatest(2, ceil(n * 0.8e0))) AS capacity FROM range(2, 1001) t(n))
SELECT shape, n AS n_rows, least(greatest(columns, min_columns), least(max_columns, capacity))::BIGINT AS n_columns FROM b JOIN r ON n BETWEEN min_rows AND bounded AND capacity >= min_columns QUALIFY row_number() OVER (PARTITION BY shape ORDER BY n DESC) = 1""")
def _(s, d):
    k = F.col("c_custkey")
    wanted = table(s, d, "customer").select(
        k.alias("shape"), (k % 900 + 2).alias("rows"), (3 + k % 40).alias("min_rows"), (60 + k % 700).alias("max_rows"),
        (F.col("c_nationkey") + 1).cast("long").alias("columns"), (1 + k % 9).alias("min_columns"), (4 + k % 12).alias("max_columns"),
    )
    supports = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("column_index")).agg(F.count(F.lit(1)).alias("support"))
    return results.feasible_shapes(wanted, supports)


@query("q_bundle_faults", """WITH c AS (SELECT l_orderkey AS row_index, l_linenumber AS column_index, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS num, CASE WHEN l_linenumber IN (3, 4) THEN l_suppkey % 6 END AS code FROM lineitem),
k AS (SELECT * FROM (VALUES (1, 'numeric', NULL), (2, 'numeric', NULL), (3, 'discrete', 4), (4, 'discrete', 9)) t(column_index, kind, labels)), x AS (SELECT * FROM c LEFT JOIN k USING (column_index))
SELECT count(*) FILTER (row_index >= 1000) AS bad_rows, count(*) FILTER (kind IS NULL) AS bad_columns, count(*) FILTER ((num IS NOT NULL AND kind <> 'numeric') OR (code IS NOT NULL AND kind <> 'discrete')) AS bad_kinds,
  count(*) FILTER (kind = 'discrete' AND code >= labels) AS bad_codes, count(*) FILTER (isinf(num) OR isnan(num)) AS not_finite, count(*) - (SELECT count(*) FROM (SELECT DISTINCT row_index, column_index FROM c)) AS repeated FROM x""")
def _(s, d):
    n = F.col("l_linenumber")
    cells = table(s, d, "lineitem").select(F.col("l_orderkey").alias("row_index"), n.alias("column_index"), F.when(n != 3, F.col("l_quantity")).cast("double").alias("num"), F.when(n.isin(3, 4), F.col("l_suppkey") % 6).cast("int").alias("code"))
    columns = s.createDataFrame([(1, "numeric", None), (2, "numeric", None), (3, "discrete", ["a", "b", "c", "d"]), (4, "discrete", list("abcdefghi"))], "column_index int, kind string, categories array<string>")
    return bundle.faults(cells, columns, 1000)
