"""Registered queries of the pattern-mining operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pvalues
from ..operators import archive, assignment, contrast, evaluate, fit, joint, matching, prepare, scoring, selection, statistics, structure
from ..streaming import events as ev
from . import results
from .inputs import AUC, CUST, EMB, FIT, FITD, MEMBERS, SCORED, customer_cells, embedding_cells, label_candidates, memberships, nation_candidates, scored, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _emb(s, d):
    cells = embedding_cells(s, d)
    rows, columns = label_candidates(s, d)
    return cells, rows, columns, prepare.column_stats(cells), fit.submatrix(cells, rows, columns)


# profiles and preparation


@query("q_profile_robust", f"WITH {EMB} SELECT column_index, n, round(p05, 6) AS p05, round(median, 6) AS median, round(p95, 6) AS p95, round(rr, 6) AS robust_range, rr <= 1e-12 AS zero_scale FROM stats")
def _(s, d):
    return r6(prepare.column_stats(embedding_cells(s, d)), "p05", "median", "p95", "robust_range")


@query("q_robust_scale", f"WITH {EMB} SELECT row_index, column_index, round((num - median) / rr, 6) AS num FROM cells JOIN stats USING (column_index)")
def _(s, d):
    cells = embedding_cells(s, d)
    return r6(prepare.robust_scale(cells, prepare.column_stats(cells)), "num").select("row_index", "column_index", "num")


@query("q_impute_median_mode", f"""WITH {CUST}, med AS (SELECT column_index, median(num) AS m FROM cells WHERE num IS NOT NULL GROUP BY 1)
SELECT row_index, column_index, round(coalesce(num, m), 6) AS num, coalesce(code, mode)::INT AS code, num IS NOT NULL OR code IS NOT NULL AS observed, num IS NOT NULL OR code IS NOT NULL OR m IS NOT NULL OR mode IS NOT NULL AS available
FROM cells LEFT JOIN med USING (column_index) LEFT JOIN modes USING (column_index)""")
def _(s, d):
    return r6(prepare.impute_median_mode(customer_cells(s, d)), "num").select("row_index", "column_index", "num", "code", "observed", "available")


@query("q_missing_counts", f"WITH {CUST} SELECT column_index, count(*) AS n_rows, count(*) FILTER (num IS NULL AND code IS NULL) AS n_missing, round(count(*) FILTER (num IS NULL AND code IS NULL) / count(*)::DOUBLE, 6) AS missing_ratio FROM cells GROUP BY 1")
def _(s, d):
    return r6(prepare.missing_counts(customer_cells(s, d)), "missing_ratio")


@query("q_missing_indicators", f"""WITH {CUST}, k AS (SELECT column_index, row_number() OVER (ORDER BY column_index) + 3 AS new FROM (SELECT column_index, count(*) FILTER (num IS NULL AND code IS NULL) / count(*)::DOUBLE AS q FROM cells GROUP BY 1) WHERE q BETWEEN 0.08 AND 0.5)
SELECT row_index, new::INT AS column_index, (num IS NULL AND code IS NULL)::INT AS code, column_index AS source_column_index FROM cells JOIN k USING (column_index)""")
def _(s, d):
    return prepare.missingness_indicators(customer_cells(s, d), 4, 0.08, 0.5).select("row_index", "column_index", "code", "source_column_index")


@query("q_drop_all_missing", f"""WITH {CUST}, k AS (SELECT column_index, row_number() OVER (ORDER BY column_index) - 1 AS new FROM cells GROUP BY 1 HAVING count(num) + count(code) > 0)
SELECT row_index, new::INT AS column_index, round(num, 6) AS num, code, column_index AS source_column_index FROM cells JOIN k USING (column_index)""")
def _(s, d):
    return r6(prepare.drop_all_missing(customer_cells(s, d)), "num").select("row_index", "column_index", "num", "code", "source_column_index")


@query("q_encode_frequencies", f"WITH {CUST} SELECT column_index, code, n, round(frequency, 6) AS frequency, cardinality FROM freq")
def _(s, d):
    return r6(prepare.frequencies(customer_cells(s, d)), "frequency")


@query("q_support_gate", f"WITH {EMB} SELECT candidate, column_index, count(*) AS n_rows, count(num) AS support, count(num) >= greatest(2, ceil(count(*) * 0.97e0)) AS enough FROM inside GROUP BY 1, 2")
def _(s, d):
    return fit.supported(_emb(s, d)[4], "num", 0.97)


@query("q_signature", f"""WITH {EMB}, r AS (SELECT candidate, string_agg(row_index::VARCHAR, ',' ORDER BY row_index) AS r FROM crows GROUP BY 1), c AS (SELECT candidate, string_agg(column_index::VARCHAR, ',' ORDER BY column_index) AS c FROM ccols GROUP BY 1)
SELECT candidate, sha256('r:' || r || '|c:' || c) AS signature FROM r JOIN c USING (candidate)""")
def _(s, d):
    rows, columns = label_candidates(s, d)
    out = rows.groupBy("candidate").agg(F.collect_list("row_index").alias("r")).join(columns.groupBy("candidate").agg(F.collect_list("column_index").alias("c")), "candidate")
    return out.select("candidate", evaluate.signature(F.col("r"), F.col("c")).alias("signature"))


# fits, contrast and objectives


@query("q_fit_constant_numeric", f"WITH {FIT} SELECT candidate, column_index, round(parameter, 6) AS parameter, support, round(error, 6) AS error FROM fits")
def _(s, d):
    _, _, _, stats, inside = _emb(s, d)
    return r6(fit.constant_fit_numeric(inside, stats), "parameter", "error")


@query("q_coherence", f"WITH {FIT} SELECT candidate, round(sqrt(avg(coalesce(error, 1) * coalesce(error, 1))), 6) AS coherence FROM ccols LEFT JOIN fits USING (candidate, column_index) GROUP BY 1")
def _(s, d):
    _, _, columns, stats, inside = _emb(s, d)
    return r6(evaluate.coherence(fit.constant_fit_numeric(inside, stats), columns), "coherence")


_C = FIT + AUC.replace("{r}", "abs(num - parameter)").replace("{join}", "JOIN fits USING (candidate, column_index)")


@query("q_contrast_numeric", f"WITH {_C} SELECT candidate, column_index, round(contrast, 6) AS contrast, true AS valid FROM auc")
def _(s, d):
    cells, rows, columns, stats, inside = _emb(s, d)
    return r6(contrast.constant_contrast_numeric(cells, rows, columns, fit.constant_fit_numeric(inside, stats)), "contrast")


_EVAL = f"""WITH {_C}, n AS (SELECT candidate, count(*) AS n_rows FROM crows GROUP BY 1), m AS (SELECT candidate, count(*) AS n_columns FROM ccols GROUP BY 1),
h AS (SELECT candidate, sqrt(avg(coalesce(error, 1) * coalesce(error, 1))) AS coherence, avg(coalesce(contrast, 0)) AS contrast FROM ccols LEFT JOIN fits USING (candidate, column_index) LEFT JOIN auc USING (candidate, column_index) GROUP BY 1),
t AS (SELECT count(DISTINCT row_index)::DOUBLE AS tr, count(DISTINCT column_index)::DOUBLE AS tc FROM cells),
v AS (SELECT *, 2 * (n_rows / tr) * (n_columns / tc) / (n_rows / tr + n_columns / tc) AS size FROM n JOIN m USING (candidate) JOIN h USING (candidate), t)
SELECT candidate, n_rows, n_columns, round(coherence, 6) AS coherence, round(contrast, 6) AS contrast, round(size, 6) AS size, round(greatest(0, coherence - 0.25e0), 6) AS violation, coherence <= 0.25e0 AS feasible FROM v"""


@query("q_exact_percentiles", """SELECT l_returnflag AS flag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999
FROM lineitem GROUP BY 1""")
def _(s, d):
    x = prepare.exact_percentiles(table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), ["flag"], "l_extendedprice", [0.01, 0.5, 0.999])
    return x.select("flag", "n", *[F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("p01", "p50", "p999"))])


@query("q_evaluate_constant", _EVAL)
def q_evaluate_constant(s, d):
    cells, rows, columns, stats, _ = _emb(s, d)
    return r6(evaluate.evaluate_constant(cells, rows, columns, stats, max_coherence=0.25), "coherence", "contrast", "size", "violation")


_MANY = _EVAL.replace("SELECT label::BIGINT AS candidate, vec_id::BIGINT AS row_index FROM embeddings", "SELECT DISTINCT ((vec_id * 37 + k * 101) % 1000)::BIGINT AS candidate, vec_id::BIGINT AS row_index FROM embeddings, range(20) t(k)")
_MANY = _MANY.replace("SELECT (c % 10)::BIGINT AS candidate, c::INT AS column_index FROM range(64) t(c)", "SELECT i::BIGINT AS candidate, ((i * 7 + k * 11) % 64)::INT AS column_index FROM range(1000) u(i), range(6) t(k)")


def _thousand(s, d):
    k = F.col("k")
    rows = table(s, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    rows = rows.select(((F.col("vec_id") * 37 + k * 101) % 1000).cast("long").alias("candidate"), F.col("vec_id").cast("long").alias("row_index")).distinct()
    columns = s.range(1000).select(F.col("id").alias("candidate"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return rows, columns.select("candidate", ((F.col("candidate") * 7 + k * 11) % 64).cast("int").alias("column_index"))


@query("q_evaluate_thousand", _MANY)
def q_evaluate_thousand(s, d):
    """A thousand overlapping candidates in one plan."""
    cells = embedding_cells(s, d)
    rows, columns = _thousand(s, d)
    return r6(evaluate.evaluate_constant(cells, rows, columns, prepare.column_stats(cells), max_coherence=0.25), "coherence", "contrast", "size", "violation")


@query("q_fit_constant_discrete", f"WITH {FITD} SELECT candidate, column_index, mode::INT AS mode, round(error, 6) AS error, support::BIGINT AS support FROM fits")
def _(s, d):
    cells = customer_cells(s, d)
    rows, columns = nation_candidates(s, d)
    return r6(fit.constant_fit_discrete(fit.submatrix(cells, rows, columns), prepare.frequencies(cells), 0.7), "error")


@query("q_contrast_discrete", f"""WITH {FITD}, x AS (SELECT ccols.candidate, column_index, (code = mode)::INT::DOUBLE AS hit, crows.row_index IS NOT NULL AS local FROM cells JOIN ccols USING (column_index)
  JOIN fits USING (candidate, column_index) LEFT JOIN crows ON crows.candidate = ccols.candidate AND crows.row_index = cells.row_index WHERE code IS NOT NULL),
p AS (SELECT candidate, column_index, avg(hit) FILTER (local) AS inside, avg(hit) FILTER (NOT local) AS outside FROM x GROUP BY 1, 2)
SELECT candidate, column_index, round(inside, 6) AS inside, round(outside, 6) AS outside, round(CASE WHEN inside >= outside THEN CASE WHEN outside < 1 THEN 0.5e0 + 0.5e0 * (inside - outside) / (1 - outside) ELSE 0.5e0 END
  ELSE CASE WHEN outside > 0 THEN 0.5e0 + 0.5e0 * (inside - outside) / outside ELSE 0.5e0 END END, 6) AS contrast FROM p""")
def _(s, d):
    cells = customer_cells(s, d)
    rows, columns = nation_candidates(s, d)
    fits = fit.constant_fit_discrete(fit.submatrix(cells, rows, columns), prepare.frequencies(cells), 0.7)
    return r6(contrast.constant_contrast_discrete(cells, rows, columns, fits), "inside", "outside", "contrast").drop("n_outside", "of_outside")


_B = "beta AS (SELECT candidate, column_index, median(num) AS beta FROM inside GROUP BY 1, 2)"
_A = "alpha AS (SELECT candidate, row_index, median(num - beta) AS alpha FROM cells JOIN ccols USING (column_index) JOIN beta USING (candidate, column_index) GROUP BY 1, 2 HAVING count(num) >= greatest(2, ceil(count(*) * 0.8e0)))"


@query("q_additive_row_effects", f"WITH {EMB}, {_B}, {_A} SELECT candidate, row_index, round(alpha, 6) AS alpha FROM alpha")
def _(s, d):
    cells, _, columns, _, inside = _emb(s, d)
    return r6(fit.additive_row_effects(cells, columns, fit.column_medians(inside)), "alpha")


@query("q_multiplicative_row_effects", f"WITH {EMB}, {_B} SELECT candidate, row_index, round(median(num / beta), 5) AS alpha FROM cells JOIN ccols USING (column_index) JOIN beta USING (candidate, column_index) WHERE abs(beta) > 1e-12 GROUP BY 1, 2 HAVING count(num) >= 2")
def _(s, d):
    cells, _, columns, _, inside = _emb(s, d)
    return fit.multiplicative_row_effects(cells, columns, fit.column_medians(inside)).withColumn("alpha", F.round("alpha", 5))


_STEP = """a{k} AS (SELECT candidate, row_index, median(num - beta) AS x FROM inside JOIN {b} USING (candidate, column_index) WHERE num IS NOT NULL GROUP BY 1, 2),
c{k} AS (SELECT candidate, row_index, x - median(x) OVER (PARTITION BY candidate) AS alpha FROM a{k}),
b{k} AS (SELECT candidate, column_index, median(num - alpha) AS beta FROM inside JOIN c{k} USING (candidate, row_index) WHERE num IS NOT NULL GROUP BY 1, 2)"""


@query("q_additive_fit_unrolled", f"WITH {EMB}, {_B}, {_STEP.format(k=1, b='beta')}, {_STEP.format(k=2, b='b1')} SELECT candidate, column_index, round(beta, 6) AS beta FROM b2")
def _(s, d):
    inside = _emb(s, d)[4]
    beta = fit.column_medians(inside)
    for _ in range(2):
        _, beta = fit.additive_step(inside, beta)
    return r6(beta, "beta")


@query("q_contrast_additive", f"WITH {EMB}, {_B}, {_A}" + AUC.replace("{r}", "abs(num - alpha - beta)").replace("{join}", "JOIN alpha USING (candidate, row_index) JOIN beta USING (candidate, column_index)") + "SELECT candidate, column_index, round(contrast, 6) AS contrast, true AS valid FROM auc")
def _(s, d):
    cells, rows, columns, _, inside = _emb(s, d)
    beta = fit.column_medians(inside)
    return r6(contrast.additive_contrast(cells, rows, columns, fit.additive_row_effects(cells, columns, beta), beta), "contrast")


_SCALED = EMB.replace("cells", "raw") + """, cells AS (SELECT row_index, column_index, num / CASE WHEN rr > 1e-12 THEN rr ELSE greatest(abs(median), 1) END AS num FROM raw JOIN stats USING (column_index)),
held AS (SELECT candidate, row_index, column_index, num FROM cells JOIN ccols USING (column_index) JOIN crows USING (candidate, row_index))"""


@query("q_contrast_multiplicative", f"""WITH {_SCALED}, {_B.replace("inside", "held")}, alpha AS (SELECT candidate, row_index, median(num / beta) AS alpha FROM cells JOIN ccols USING (column_index) JOIN beta USING (candidate, column_index) WHERE abs(beta) > 1e-12 GROUP BY 1, 2 HAVING count(num) >= 2)"""
    + AUC.replace("{r}", "abs(num - alpha * beta)").replace("{join}", "JOIN alpha USING (candidate, row_index) JOIN beta USING (candidate, column_index)") + "SELECT candidate, column_index, round(contrast, 5) AS contrast, true AS valid FROM auc")
def _(s, d):
    cells, rows, columns, stats, _ = _emb(s, d)
    cells = fit.scaled_cells(cells, stats)
    beta = fit.column_medians(fit.submatrix(cells, rows, columns))
    return contrast.multiplicative_contrast(cells, rows, columns, fit.multiplicative_row_effects(cells, columns, beta), beta).withColumn("contrast", F.round("contrast", 5))


@query("q_joint_fit_additive")
def _(s, d):
    _, _, _, stats, inside = _emb(s, d)
    return r6(joint.joint_fit(inside, stats, "additive"), "beta", "error")


@query("q_joint_fit_multiplicative")
def _(s, d):
    _, _, _, stats, inside = _emb(s, d)
    return r6(joint.joint_fit(inside, stats, "multiplicative"), "beta", "error")


@query("q_joint_thousand")
def _(s, d):
    """Additive fits of a thousand overlapping candidates in one plan."""
    cells = embedding_cells(s, d)
    return r6(joint.joint_fit(fit.submatrix(cells, *_thousand(s, d)), prepare.column_stats(cells), "additive"), "beta", "error")


@query("q_best_pattern")
def _(s, d):
    _, _, _, stats, inside = _emb(s, d)
    out = assignment.assign(inside, stats, fit.constant_fit_numeric(inside, stats)).columns
    return r6(out, "error", "parameter", "reference", "margin")


_KINDS = f"""{FITD},
st AS (SELECT quantile_cont(num, 0.95) - quantile_cont(num, 0.05) AS rr FROM cells WHERE column_index = 0),
own AS (SELECT candidate, num FROM cells JOIN crows USING (row_index) WHERE column_index = 0),
par AS (SELECT candidate, median(num) AS p FROM own GROUP BY 1 HAVING count(num) >= greatest(2, ceil(count(*) * 0.7e0))),
nf AS (SELECT candidate, avg(least(1e0, abs(num - p) / rr)) AS error FROM own JOIN par USING (candidate), st WHERE num IS NOT NULL GROUP BY 1),
res AS (SELECT par.candidate, abs(num - p) AS r, (crows.row_index IS NOT NULL)::INT AS local FROM par CROSS JOIN cells LEFT JOIN crows ON crows.candidate = par.candidate AND crows.row_index = cells.row_index
  WHERE column_index = 0 AND num IS NOT NULL),
rk AS (SELECT *, coalesce(sum(local) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-10 PRECEDING), 0) AS lo, coalesce(sum(local) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-10 FOLLOWING), 0) AS up
  FROM res WINDOW w AS (PARTITION BY candidate ORDER BY r)),
auc AS (SELECT candidate, sum(CASE WHEN local = 0 THEN lo + 0.5e0 * (up - lo) END) / (sum(local) * sum(1 - local))::DOUBLE AS contrast FROM rk GROUP BY 1),
dx AS (SELECT ccols.candidate, column_index, (code = mode)::INT::DOUBLE AS hit, crows.row_index IS NOT NULL AS local FROM cells JOIN ccols USING (column_index)
  JOIN fits USING (candidate, column_index) LEFT JOIN crows ON crows.candidate = ccols.candidate AND crows.row_index = cells.row_index WHERE code IS NOT NULL),
dp AS (SELECT candidate, column_index, avg(hit) FILTER (local) AS i, avg(hit) FILTER (NOT local) AS o FROM dx GROUP BY 1, 2),
every AS (SELECT n_nationkey::BIGINT AS candidate, c AS column_index FROM nation, (SELECT unnest([0, 2, 3]) AS c)),
col AS (SELECT candidate, 0 AS column_index, error, contrast FROM nf JOIN auc USING (candidate)
  UNION ALL SELECT candidate, column_index, error, CASE WHEN i >= o THEN CASE WHEN o < 1 THEN 0.5e0 + 0.5e0 * (i - o) / (1 - o) ELSE 0.5e0 END ELSE CASE WHEN o > 0 THEN 0.5e0 + 0.5e0 * (i - o) / o ELSE 0.5e0 END END
  FROM fits JOIN dp USING (candidate, column_index)),
per AS (SELECT candidate, sqrt(avg(power(coalesce(error, 1), 2))) AS coherence, avg(coalesce(contrast, 0)) AS contrast, count(error) = 3 AS valid FROM every LEFT JOIN col USING (candidate, column_index) GROUP BY 1),
size AS (SELECT candidate, count(*) AS n_rows, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS r, 3 / 4e0 AS c FROM crows GROUP BY 1 HAVING count(*) >= 2)"""


def _nation_three(s, d):
    columns = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("candidate"), F.explode(F.array(*map(F.lit, (0, 2, 3)))).alias("column_index"))
    return nation_candidates(s, d)[0], columns


@query("q_evaluate_kinds", f"""WITH {_KINDS} SELECT candidate, n_rows, round(coherence, 6) AS coherence, round(contrast, 6) AS contrast, round(2 * r * c / (r + c), 6) AS size, valid
  FROM size JOIN per USING (candidate)""")
def _(s, d):
    found = scoring.evaluate_biclusters(customer_cells(s, d), *_nation_three(s, d), patterns=(scoring.CONSTANT,), ratio=0.7).summary
    return r6(found.filter("coherence IS NOT NULL"), "coherence", "contrast", "size").select("candidate", "n_rows", "coherence", "contrast", "size", "valid")


@query("q_evaluate_columns", f"""WITH {_KINDS} SELECT candidate, column_index, CASE WHEN error IS NOT NULL THEN 'constant' END AS pattern, round(coalesce(error, 1), 6) AS error, round(coalesce(contrast, 0), 6) AS contrast
  FROM every JOIN size USING (candidate) LEFT JOIN col USING (candidate, column_index)""")
def _(s, d):
    found = scoring.evaluate_biclusters(customer_cells(s, d), *_nation_three(s, d), patterns=(scoring.CONSTANT,), ratio=0.7).columns
    return r6(found, "error", "contrast").select("candidate", "column_index", "pattern", "error", "contrast")


@query("q_evaluate_mixed")
def _(s, d):
    """All patterns over the embeddings and their label, a discrete column of its own."""
    label = table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("row_index"), F.lit(64).alias("column_index"), F.lit(None).cast("double").alias("num"), F.col("label").cast("int").alias("code"))
    cells, rows, columns, *_ = _emb(s, d)
    cells = cells.select("row_index", "column_index", "num", F.lit(None).cast("int").alias("code")).unionByName(label)
    columns = columns.unionByName(columns.select("candidate", F.lit(64).alias("column_index")).distinct())
    return r6(scoring.evaluate_biclusters(cells, rows, columns).summary, "coherence", "contrast", "size", "violation")


# records of evaluated candidates


@query("q_mean_loss", f"WITH {SCORED} SELECT id AS candidate, round((coherence + (1 - contrast)) / 2, 6) AS loss FROM scored")
def _(s, d):
    x = scored(s, d)
    long = x.select(F.col("id").alias("candidate"), F.lit("MINIMIZE").alias("direction"), F.col("coherence").alias("value")).unionByName(x.select(F.col("id").alias("candidate"), F.lit("MAXIMIZE").alias("direction"), F.col("contrast").alias("value")))
    return r6(evaluate.mean_loss(long), "loss")


@query("q_grid_bins", f"""WITH {SCORED} SELECT id, CASE WHEN coherence BETWEEN 0 AND 1 THEN least(7, floor(coherence * 8))::INT END AS linear,
  CASE WHEN n_rows BETWEEN 4 AND 90 THEN least(7, floor(ln(n_rows / 4e0) / ln(90 / 4e0) * 8))::INT END AS geometric,
  len(list_filter([0.25e0, 0.5e0, 0.75e0], lambda b: b <= contrast))::INT AS custom, (n_columns - 2)::INT AS exact FROM scored""")
def _(s, d):
    return scored(s, d).select(
        "id", archive.linear_bin(F.col("coherence"), 0.0, 1.0, 8).alias("linear"), archive.geometric_bin(F.col("n_rows"), 4, 90, 8).alias("geometric"),
        archive.custom_bin(F.col("contrast"), [0.25, 0.5, 0.75]).alias("custom"), archive.exact_bin(F.col("n_columns"), 2).alias("exact"),
    )


_DOM = "b.loss1 <= a.loss1 AND b.loss2 <= a.loss2 AND (b.loss1 < a.loss1 OR b.loss2 < a.loss2)"


@query("q_pareto_cell", f"WITH {SCORED} SELECT id, cell FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.cell = a.cell AND {_DOM})")
def _(s, d):
    return archive.pareto_front(scored(s, d), "loss1", "loss2").select("id", "cell")


@query("q_constrained_front", f"WITH {SCORED} SELECT id, cell FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.cell = a.cell AND (greatest(b.violation, 0) < greatest(a.violation, 0) OR (greatest(b.violation, 0) = greatest(a.violation, 0) AND {_DOM})))")
def _(s, d):
    return archive.constrained_front(scored(s, d), "loss1", "loss2").select("id", "cell")


def _dominates(*losses: str) -> str:
    return " AND ".join(f"b.{x} <= a.{x}" for x in losses) + f" AND ({' OR '.join(f'b.{x} < a.{x}' for x in losses)})"


@query("q_pareto_three", f"WITH {SCORED} SELECT id, cell FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.cell = a.cell AND {_dominates('loss1', 'loss2', 'n_rows')})")
def _(s, d):
    return archive.pareto_front(scored(s, d), "loss1", "loss2", "n_rows").select("id", "cell")


@query("q_pareto_four", f"WITH {SCORED} SELECT id, generation FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.generation = a.generation AND {_dominates('loss1', 'loss2', 'n_rows', 'n_columns')})")
def _(s, d):
    return archive.pareto_front(scored(s, d), "loss1", "loss2", "n_rows", "n_columns", cell="generation").select("id", "generation")


_GAP = "CASE WHEN max({0}) OVER c - min({0}) OVER c <= 1e-15 THEN 0 ELSE coalesce((lead({0}) OVER {1} - lag({0}) OVER {1}) / (max({0}) OVER c - min({0}) OVER c), 'inf'::DOUBLE) END"


@query("q_crowding", f"""WITH {SCORED}, g AS (SELECT id, cell, {_GAP.format("loss1", "a")} AS g1, {_GAP.format("loss2", "b")} AS g2
  FROM scored WINDOW a AS (PARTITION BY cell ORDER BY loss1, id), b AS (PARTITION BY cell ORDER BY loss2, id), c AS (PARTITION BY cell))
SELECT id, cell, round(g1 + g2, 6) AS crowding FROM g""")
def _(s, d):
    return r6(archive.crowding(scored(s, d), ["loss1", "loss2"]), "crowding").select("id", "cell", "crowding")


@query("q_topk_cell", f"WITH {SCORED} SELECT id, cell, rank::INT AS rank FROM (SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY loss1, loss2, id) AS rank FROM scored) WHERE rank <= 8")
def _(s, d):
    return archive.top_k_per_cell(scored(s, d), [F.col("loss1"), F.col("loss2"), F.col("id")], 8).select("id", "cell", "rank")


@query("q_archive_insert")
def _(s, d):
    x = scored(s, d).withColumn("sequence", F.col("id")).withColumn("valid", F.col("id") % 17 != 0).withColumn("cell", F.when(F.col("id") % 19 != 0, F.col("cell")))
    return archive.insert_fold(x)


@query("q_cell_targets", f"WITH {SCORED}, o AS (SELECT n_columns AS x, n_rows // 4 AS y, count(*) AS n FROM scored GROUP BY 1, 2) SELECT i::INT AS x, j::INT AS y, coalesce(n, 0)::BIGINT AS n FROM range(16) u(i) CROSS JOIN range(32) v(j) LEFT JOIN o ON o.x = i AND o.y = j")
def _(s, d):
    o = scored(s, d).select(F.col("n_columns").cast("int").alias("x"), F.floor(F.col("n_rows") / 4).cast("int").alias("y"))
    return archive.cell_targets(o, [16, 32])


@query("q_bin_bounds", """WITH b AS (SELECT s_suppkey::BIGINT AS axis, (s_suppkey % 7 + 1)::DOUBLE AS low, (s_suppkey % 7 + 1 + s_suppkey % 90 + 5)::DOUBLE AS high, (s_suppkey % 6 + 2)::INT AS bins FROM supplier),
x AS (SELECT *, unnest(range(bins))::INT AS bin FROM b)
SELECT axis, bin, round(low * power(high / low, bin / bins::DOUBLE), 6) AS "from", round(low * power(high / low, (bin + 1) / bins::DOUBLE), 6) AS "to", round(low * power(high / low, (bin + 0.5e0) / bins::DOUBLE), 6) AS representative FROM x""")
def _(s, d):
    k = F.col("s_suppkey")
    b = table(s, d, "supplier").select(k.cast("long").alias("axis"), (k % 7 + 1).cast("double").alias("low"), (k % 7 + 1 + k % 90 + 5).cast("double").alias("high"), (k % 6 + 2).cast("int").alias("bins"))
    return r6(archive.bin_bounds(b, "low", "high", "bins", geometric=True), "from", "to", "representative").select("axis", "bin", "from", "to", "representative")


@query("q_dedup_representative", f"""WITH {SCORED}, s AS (SELECT signature, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS sources FROM scored GROUP BY 1)
SELECT id, signature, sources FROM (SELECT id, signature FROM scored QUALIFY row_number() OVER (PARTITION BY signature ORDER BY coherence, contrast DESC, generation, id) = 1) JOIN s USING (signature)""")
def _(s, d):
    return selection.representatives(scored(s, d)).select("id", "signature", "sources")


@query("q_utilities", f"WITH {SCORED} SELECT id, round(((max(coherence) OVER () - coherence) / (max(coherence) OVER () - min(coherence) OVER ()) + (contrast - min(contrast) OVER ()) / (max(contrast) OVER () - min(contrast) OVER ())) / 2, 6) AS utility FROM scored")
def _(s, d):
    return r6(selection.utilities(scored(s, d), ["coherence"], ["contrast"]), "utility").select("id", "utility")


def _knee_sql(quality: str) -> str:
    return f"""WITH {SCORED}, o AS (SELECT {quality} AS q, row_number() OVER (ORDER BY {quality} DESC) - 1 AS i FROM scored),
b AS (SELECT count(*) AS n, max(q) - min(q) AS span, min(q) AS lo, quantile_cont(q, 0.5) AS m FROM o),
p AS (SELECT q, i, (q - lo) / nullif(span, 0) - 1 + i / nullif(n - 1, 0)::DOUBLE AS p FROM o, b WHERE i BETWEEN 1 AND n - 2),
u AS (SELECT q AS uq, i AS ui, p AS up FROM p ORDER BY p DESC, i LIMIT 1), l AS (SELECT q AS lq, i AS li, -p AS lp FROM p ORDER BY p, i LIMIT 1),
k AS (SELECT *, greatest(0, least(up, lp)) AS pr, coalesce(ui < li AND greatest(0, least(up, lp)) + 1e-12 >= 0.05e0, false) AS knee FROM b LEFT JOIN u ON true LEFT JOIN l ON true)
SELECT round(CASE WHEN n < 8 THEN 0.5e0 ELSE greatest(0.5e0, least(0.85e0, CASE WHEN knee THEN (uq + lq) / 2 ELSE m END)) END, 6) AS floor,
  CASE WHEN n < 8 THEN 'minimum' WHEN knee THEN 'knee' ELSE 'quantile' END AS source, n, round(span, 6) AS span, round(CASE WHEN n >= 8 AND knee THEN pr ELSE 0 END, 6) AS prominence FROM k"""


_S_CURVE = "(tanh((contrast - 0.62e0) * 9e0) + 1e0) / 2e0"


@query("q_quality_knee", _knee_sql(_S_CURVE))
def _(s, d):
    x = scored(s, d).withColumn("quality", (F.tanh((F.col("contrast") - 0.62) * 9.0) + 1.0) / 2.0)
    return r6(selection.quality_knee(x), "floor", "span", "prominence")


@query("q_quality_quantile", _knee_sql("contrast * contrast"))
def _(s, d):
    return r6(selection.quality_knee(scored(s, d).withColumn("quality", F.col("contrast") * F.col("contrast"))), "floor", "span", "prominence")


@query("q_evidence_first_round", f"""WITH {SCORED}, t AS (SELECT count(*) AS m FROM customer) SELECT id, round((greatest(contrast - 0.5e0, 0) / 0.5e0 - 0.5e0 * greatest(0.5e0 - contrast, 0) / 0.5e0) * n_rows * n_columns - 0.25e0 * (
  (lgamma(m + 1) - lgamma(n_rows + 1) - lgamma(m + 1 - n_rows)) / ln(2) + (lgamma(65) - lgamma(n_columns + 1) - lgamma(65 - n_columns)) / ln(2)), 4) AS net FROM scored, t""")
def _(s, d):
    x = scored(s, d).withColumn("quality", F.col("contrast"))
    return selection.first_round_gain(x, table(s, d, "customer").count(), 64).select("id", F.round("net", 4).alias("net"))


@query("q_evidence_cover")
def _(s, d):
    m = memberships(s, d)
    quality = m["det_rows"].select("id").distinct().withColumn("quality", 0.6 + F.col("id") % 7 / 20.0)
    return selection.evidence_cover(quality, m["det_rows"], m["det_columns"], table(s, d, "customer").count(), 12)


@query("q_emitter_feedback", f"WITH {SCORED} SELECT generation AS emitter, count(*) AS evaluated, count(*) FILTER (violation <= 0) AS accepted, count(DISTINCT cell) AS cells, round(avg(contrast), 6) AS credit FROM scored GROUP BY 1")
def _(s, d):
    x = scored(s, d).groupBy(F.col("generation").alias("emitter")).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("violation") <= 0).alias("accepted"), F.count_distinct("cell").alias("cells"), F.avg("contrast").alias("credit"))
    return r6(x, "credit")


# overlap


@query("q_jaccard_pairs", f"WITH {MEMBERS} SELECT a, b, round(row_jaccard, 6) AS row_jaccard, round(column_jaccard, 6) AS column_jaccard, round(similarity, 6) AS similarity, round(1 - similarity, 6) AS distance FROM pairs")
def _(s, d):
    return r6(_pairs(s, d), "row_jaccard", "column_jaccard", "similarity", "distance").drop("shared_rows", "shared_columns")


def _pairs(s, d):
    m = memberships(s, d)
    return structure.jaccard_pairs(m["ref_rows"], m["ref_columns"], m["det_rows"], m["det_columns"])


@query("q_best_match", f"WITH {MEMBERS} SELECT a, b, round(similarity, 6) AS similarity FROM best")
def _(s, d):
    return r6(structure.best_match(_pairs(s, d)), "similarity").select("a", "b", "similarity")


@query("q_relevance", f"""WITH {MEMBERS}, r AS (SELECT a, max(row_jaccard) AS r FROM rj GROUP BY 1), c AS (SELECT a, max(column_jaccard) AS c FROM cj GROUP BY 1)
SELECT round(sqrt(avg(coalesce(r, 0)) * avg(coalesce(c, 0))), 6) AS value FROM (SELECT DISTINCT id AS a FROM ref_rows) LEFT JOIN r USING (a) LEFT JOIN c USING (a)""")
def _(s, d):
    m = memberships(s, d)
    return r6(structure.relevance(m["ref_rows"].select("id").distinct(), structure.overlap(m["ref_rows"], m["det_rows"], "row_index"), structure.overlap(m["ref_columns"], m["det_columns"], "column_index")), "value")


@query("q_coverage_thresholds", f"WITH {MEMBERS} SELECT round(avg((coalesce(similarity, 0) >= 0.08)::INT), 6) AS coverage_at_0_08, round(avg((coalesce(similarity, 0) >= 0.12)::INT), 6) AS coverage_at_0_12 FROM (SELECT DISTINCT id AS a FROM ref_rows) LEFT JOIN best USING (a)")
def _(s, d):
    m = memberships(s, d)
    return r6(structure.coverage(structure.best_match(_pairs(s, d)), m["ref_rows"].select("id").distinct(), [0.08, 0.12]), "coverage_at_0_08", "coverage_at_0_12")


@query("q_cell_overlap", f"""WITH {MEMBERS}, x AS (SELECT row_index, column_index, count(*) AS n FROM ref_rows JOIN ref_columns USING (id) GROUP BY 1, 2), y AS (SELECT row_index, column_index, count(*) AS m FROM det_rows JOIN det_columns USING (id) GROUP BY 1, 2)
SELECT sum(greatest(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS cells FROM x FULL JOIN y USING (row_index, column_index)""")
def _(s, d):
    m = memberships(s, d)
    return structure.cell_union(m["ref_rows"].join(m["ref_columns"], "id"), m["det_rows"].join(m["det_columns"], "id"))


@query("q_containment", """WITH r AS (SELECT i::BIGINT AS id, c_custkey AS k FROM customer, range(1, 7) t(i) WHERE c_custkey % 64 < power(2, i)), n AS (SELECT id, count(*) AS n FROM r GROUP BY 1)
SELECT a.id AS inner, b.id AS outer FROM r a JOIN r b ON a.k = b.k AND a.id < b.id JOIN n ON n.id = a.id GROUP BY 1, 2 HAVING count(*) = any_value(n.n)""")
def _(s, d):
    m = memberships(s, d)
    return structure.containment(m["nested_rows"], m["nested_columns"])


@query("q_diversity", f"WITH {MEMBERS} SELECT id, round(coalesce(min(1 - similarity), 1), 6) AS nearest FROM (SELECT DISTINCT id FROM ref_rows) LEFT JOIN pairs ON a = id AND b <> id GROUP BY 1")
def _(s, d):
    return r6(structure.nearest_distance(_pairs(s, d), memberships(s, d)["ref_rows"].select("id").distinct()), "nearest")


@query("q_assignment")
def _(s, d):
    p = _pairs(s, d).select((F.col("a") % 5).alias("task"), "a", "b", F.col("similarity").alias("weight"))
    return r6(matching.matched_weight(p, "task"), "matched")


def _shared(s, d):
    return _pairs(s, d).select("a", "b", (F.col("shared_rows") * F.col("shared_columns")).alias("weight"))


def _member_cells(s, d):
    m = memberships(s, d)
    return m["ref_rows"].join(m["ref_columns"], "id"), m["det_rows"].join(m["det_columns"], "id")


@query("q_error_complement")
def _(s, d):
    """Clustering-error complement: best one-to-one shared cells over the cells of the multiset union."""
    union = structure.cell_union(*_member_cells(s, d))
    return r6(matching.matched_weight(_shared(s, d)).crossJoin(F.broadcast(union)).select((F.col("matched") / F.col("cells")).alias("value")), "value")  # one row each


@query("q_bootstrap_error")
def _(s, d):
    return matching.bootstrap_error(_shared(s, d), *_member_cells(s, d)).select(*[F.round(c, 4).alias(c) for c in ("estimate", "low", "high")])


@query("q_bootstrap_relevance")
def _(s, d):
    m = memberships(s, d)
    j = F.col("both") / (F.col("a_size") + F.col("b_size") - F.col("both"))
    best = lambda x, y, e, n: structure.overlap(x, y, e).groupBy(F.col("a").alias("id")).agg(F.max(j).alias(n))
    x = m["ref_rows"].select("id").distinct().join(best(m["ref_rows"], m["det_rows"], "row_index", "r"), "id", "left").join(best(m["ref_columns"], m["det_columns"], "column_index", "c"), "id", "left")
    return matching.bootstrap_relevance(x.fillna(0.0)).select(*[F.round(c, 4).alias(c) for c in ("estimate", "low", "high")])


@query("q_set_components", f"""WITH RECURSIVE {MEMBERS}, e AS (SELECT a, b + 1000 AS b FROM pairs WHERE similarity >= 0.045 UNION SELECT b + 1000, a FROM pairs WHERE similarity >= 0.045),
reach AS (SELECT DISTINCT a AS node, a AS m FROM e UNION SELECT e.b, reach.m FROM reach JOIN e ON e.a = reach.node)
SELECT node, min(m) AS component FROM reach GROUP BY node""")
def _(s, d):
    return matching.components(_pairs(s, d).filter("similarity >= 0.045").select("a", (F.col("b") + 1000).alias("b")))


def _set_scores(s, d):
    return _pairs(s, d).withColumn("right", F.col("b") % 3).select(F.lit(-1).cast("long").alias("left"), "right", "a", "b", F.col("similarity").alias("weight"))


@query("q_repertoire_stability")
def _(s, d):
    """The reference set against three sets of detected biclusters."""
    m = memberships(s, d)
    left = m["ref_rows"].agg(F.count_distinct("id").alias("left_count"))
    right = m["det_rows"].select("id").distinct().groupBy((F.col("id") % 3).alias("right")).agg(F.count(F.lit(1)).alias("right_count"))
    sizes = right.crossJoin(F.broadcast(left)).withColumn("left", F.lit(-1).cast("long"))  # one row
    return r6(matching.repertoire_stability(_set_scores(s, d), sizes, (0.05, 0.1)), "mean_matched_stability", "median_matched_stability", "coverage_at_0_05", "coverage_at_0_1")


@query("q_reference_stability")
def _(s, d):
    scores = _set_scores(s, d)
    out = matching.reference_stability(scores, memberships(s, d)["ref_rows"].select("id").distinct(), scores.select("right").distinct(), 0.05)
    return r6(out, *[c for c in out.columns if c.endswith("stability") or c == "support_fraction"])


# associations


_DOCS = "docs AS (SELECT doc_id, lang, source, n_chars, quality, toxic, (n_chars > 2000)::INT AS long FROM documents JOIN labels USING (doc_id))"


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(s, d, "labels"), "doc_id").withColumn("long", (F.col("n_chars") > 2000).cast("int"))


@query("q_fisher", f"""WITH {_DOCS}, t AS (SELECT lang, count(*) FILTER (long = 1 AND toxic = 1) AS a, count(*) FILTER (long = 1 AND toxic = 0) AS b, count(*) FILTER (long = 0 AND toxic = 1) AS c, count(*) FILTER (long = 0 AND toxic = 0) AS d FROM docs GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, (a + c) - (c + d)), least(a + b, a + c) + 1)) AS i FROM t),
p AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(c + d - a - c + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM x),
o AS (SELECT *, max(CASE WHEN i = a THEN p END) OVER (PARTITION BY lang) AS own FROM p)
SELECT lang, a, b, c, d, round(a * d / nullif(b * c, 0)::DOUBLE, 6) AS odds_ratio, round(least(1, sum(CASE WHEN p <= own * (1 + 1e-7) THEN p ELSE 0 END)), 6) AS p_value FROM o GROUP BY lang, a, b, c, d""")
def _(s, d):
    return r6(statistics.fisher(statistics.contingency(_docs(s, d), "lang", "long", "toxic")), "odds_ratio", "p_value")


@query("q_mann_whitney", f"""WITH {_DOCS}, r AS (SELECT lang, quality, n_chars, rank() OVER w + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2e0 AS k FROM docs WINDOW w AS (PARTITION BY lang ORDER BY n_chars))
SELECT lang, sum(quality)::BIGINT AS n1, sum(1 - quality)::BIGINT AS n2, round(sum(k) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2e0, 6) AS u,
  round(2 * (sum(k) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2e0) / nullif(sum(quality) * sum(1 - quality), 0) - 1, 6) AS rank_biserial,
  median(n_chars) FILTER (quality = 1)::DOUBLE AS median_in, median(n_chars) FILTER (quality = 0)::DOUBLE AS median_out FROM r GROUP BY 1""")
def _(s, d):
    return r6(statistics.mann_whitney(_docs(s, d), "lang", "quality", "n_chars"), "u", "rank_biserial").drop("z")


@query("q_mann_whitney_p")
def _(s, d):
    return r6(statistics.mann_whitney_p(_docs(s, d), "lang", "quality", "n_chars").select("lang", "p_value"), "p_value")


@query("q_log_rank_p")
def _(s, d):
    return r6(statistics.log_rank_p(_surv(s, d), "t", "e", "m", "grp").select("grp", "p_value"), "p_value")


@query("q_wilcoxon_p")
def _(s, d):
    return r6(statistics.wilcoxon_p(statistics.paired_deltas(_res(s, d), ["dataset"], "variant", "1-URGENT", "value"), "variant", "delta").select("variant", "n", "p_value"), "p_value")


@query("q_chi_square", f"""WITH {_DOCS}, o AS (SELECT lang, source, toxic, count(*) AS o FROM docs GROUP BY 1, 2, 3), a AS (SELECT lang, source, count(*) AS rx FROM docs GROUP BY 1, 2), b AS (SELECT lang, toxic, count(*) AS ry FROM docs GROUP BY 1, 2),
n AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS kx, count(DISTINCT toxic) AS ky FROM docs GROUP BY 1),
x AS (SELECT lang, sum(power(coalesce(o, 0) - rx * ry / n::DOUBLE, 2) / (rx * ry / n::DOUBLE)) AS s FROM a JOIN b USING (lang) JOIN n USING (lang) LEFT JOIN o USING (lang, source, toxic) GROUP BY 1)
SELECT lang, round(s, 6) AS statistic, (kx - 1) * (ky - 1) AS degrees, round(sqrt(s / (n * nullif(least(kx, ky) - 1, 0))), 6) AS cramers_v FROM x JOIN n USING (lang)""")
def _(s, d):
    return r6(statistics.chi_square(_docs(s, d), "lang", "source", "toxic"), "statistic", "cramers_v")


@query("q_chi_square_p")
def _(s, d):
    return statistics.chi_square(_docs(s, d), "lang", "source", "toxic").select("lang", F.round(pvalues.chi_square("statistic", "degrees"), 6).alias("p_value"))


_SURV = "v AS (SELECT event_id % 3 AS grp, floor(value / 5)::BIGINT AS t, (event_type = 'purchase')::BIGINT AS e, (user_id % 2)::BIGINT AS m FROM events)"


def _surv(s, d):
    e = table(s, d, "events")
    return e.select((F.col("event_id") % 3).alias("grp"), F.floor(F.col("value") / 5).alias("t"), (F.col("event_type") == "purchase").cast("long").alias("e"), (F.col("user_id") % 2).cast("long").alias("m"))


@query("q_log_rank", f"""WITH {_SURV}, t AS (SELECT grp, t, count(*) AS n, sum(e) AS d, sum(m) AS n1, sum(m * e) AS d1 FROM v GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER w AS nn, sum(n1) OVER w AS nn1 FROM t WINDOW w AS (PARTITION BY grp ORDER BY t DESC)), x AS (SELECT grp, d1, d * nn1 / nn::DOUBLE AS ex, CASE WHEN nn > 1 THEN d * nn1 / nn::DOUBLE * (1 - nn1 / nn::DOUBLE) * (nn - d) / (nn - 1)::DOUBLE ELSE 0 END AS va FROM r WHERE d > 0)
SELECT grp, sum(d1)::BIGINT AS observed, round(sum(ex), 5) AS expected, round(sum(va), 5) AS variance, round(power(sum(d1) - sum(ex), 2) / sum(va), 5) AS statistic FROM x GROUP BY 1""")
def _(s, d):
    x = statistics.log_rank(_surv(s, d), "t", "e", "m", "grp")
    return x.withColumns({c: F.round(c, 5) for c in ("expected", "variance", "statistic")})


@query("q_kaplan_meier", f"""WITH {_SURV}, t AS (SELECT grp, t, count(*) AS n, sum(e) AS d FROM v GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS nn FROM t),
s AS (SELECT grp, t, CASE WHEN max((d = nn)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < nn THEN ln(1 - d / nn::DOUBLE) END) OVER w) END AS s FROM r WINDOW w AS (PARTITION BY grp ORDER BY t))
SELECT grp, min(t) FILTER (s <= 0.5e0 + 1e-12) AS median_survival FROM s GROUP BY 1""")
def _(s, d):
    return statistics.kaplan_meier(_surv(s, d), "t", "e", "grp")


@query("q_cox_binary")
def _(s, d):
    return r6(statistics.cox_binary(_surv(s, d), "t", "e", "m", "grp"), "hazard_ratio")


_P = "p AS (SELECT c_custkey::BIGINT AS id, (c_nationkey % 4)::BIGINT AS family, ((c_custkey * 7919) % 9973 + 1) / 200000e0 AS p_value FROM customer)"


def _p(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.cast("long").alias("id"), (F.col("c_nationkey") % 4).cast("long").alias("family"), ((k * 7919 % 9973 + 1) / F.lit(200000.0)).alias("p_value"))


@query("q_bh_fdr", f"""WITH {_P}, r AS (SELECT *, p_value * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p_value, id) AS q FROM p)
SELECT id, family, round(least(1, min(q) OVER (PARTITION BY family ORDER BY p_value DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q_value FROM r""")
def _(s, d):
    return r6(statistics.benjamini_hochberg(_p(s, d), "id", "family"), "q_value").select("id", "family", "q_value")


@query("q_holm", f"""WITH {_P}, r AS (SELECT *, least(1, p_value * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, id) + 1)) AS q FROM p)
SELECT id, family, round(max(q) OVER (PARTITION BY family ORDER BY p_value, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS adjusted FROM r""")
def _(s, d):
    return r6(statistics.holm(_p(s, d), "id", "family"), "adjusted").select("id", "family", "adjusted")


_RES = "res AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS dataset, o_orderpriority AS variant, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def _res(s, d):
    return table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("dataset"), F.col("o_orderpriority").alias("variant")).agg(F.avg("o_totalprice").alias("value"))


_PAIRED = "pd AS (SELECT r.dataset, r.variant, r.value - b.value AS delta FROM res r JOIN res b ON r.dataset = b.dataset AND b.variant = '1-URGENT' WHERE r.variant <> '1-URGENT')"


@query("q_paired_deltas", f"WITH {_RES}, {_PAIRED} SELECT dataset, variant, round(delta, 6) AS delta FROM pd")
def _(s, d):
    return statistics.paired_deltas(_res(s, d), ["dataset"], "variant", "1-URGENT", "value").withColumn("delta", F.round("delta", 6))


@query("q_wilcoxon", f"""WITH {_RES}, {_PAIRED}, a AS (SELECT variant, delta, round(abs(delta), 12) AS x FROM pd WHERE abs(delta) > 1e-8), r AS (SELECT variant, delta, rank() OVER (PARTITION BY variant ORDER BY x) + (count(*) OVER (PARTITION BY variant, x) - 1) / 2e0 AS k FROM a)
SELECT variant, count(*) AS n, sum(CASE WHEN delta > 0 THEN k ELSE 0 END) AS w_plus, sum(CASE WHEN delta > 0 THEN 0 ELSE k END) AS w_minus, round((sum(CASE WHEN delta > 0 THEN k ELSE -k END)) / sum(k), 6) AS rank_biserial FROM r GROUP BY 1""")
def _(s, d):
    return r6(statistics.wilcoxon(statistics.paired_deltas(_res(s, d), ["dataset"], "variant", "1-URGENT", "value"), "variant", "delta"), "rank_biserial")


@query("q_grouping_all", "SELECT o_orderpriority, coalesce(o_orderstatus, 'ALL') AS pattern, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))")
def _(s, d):
    return statistics.grouped_with_all(table(s, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("q_metric_summary", f"WITH {_RES} SELECT variant, count(value) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS sd, round(median(value), 4) AS median, round(min(value), 4) AS minimum, round(max(value), 4) AS maximum FROM res GROUP BY 1")
def _(s, d):
    x = statistics.summary(_res(s, d), "variant", "value")
    return x.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "median", "minimum", "maximum")})


@query("q_bootstrap")
def _(s, d):
    return statistics.bootstrap_mean(_res(s, d), "variant", "value").withColumns({c: F.round(c, 3) for c in ("low", "high")})


@query("q_replicate_aggregate", "SELECT c_nationkey AS grp, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN any_value(c_mktsegment) END AS segment FROM customer GROUP BY 1")
def _(s, d):
    x = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.avg("c_acctbal").alias("mean"), F.median("c_acctbal").alias("median"), F.when(F.count_distinct("c_mktsegment") == 1, F.first("c_mktsegment")).alias("segment"))
    return x.withColumns({c: F.round(c, 4) for c in ("mean", "median")})


# run events


@query("q_event_rollup", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, arg_max(props, event_id) AS latest FROM events GROUP BY 1")
def _(s, d):
    x = ev.rollup(table(s, d, "events"), "event_type", "value", "event_id", "props")
    return r6(x, "mean", "p95").withColumn("total", F.round("total", 4))


@query("q_outcome_rates", "SELECT ceil((event_id + 1) / 500e0)::BIGINT AS window, count(*) AS n, " + ", ".join(f"round(avg((event_type = '{k}')::INT), 6) AS {k}_rate" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def _(s, d):
    x = ev.outcome_rates(table(s, d, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("kind")), 500)
    return r6(x, *[c for c in x.columns if c.endswith("_rate")])


@query("q_emitted_on_change", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def _(s, d):
    return ev.emitted_on_change(table(s, d, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type")


@query("q_credit_delta", "SELECT event_id, round(value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def _(s, d):
    return r6(ev.credit_delta(table(s, d, "events"), "user_id", "event_id", "value"), "delta").select("event_id", "delta")


@query("q_rolling_diversity", """SELECT event_id, sum(f) OVER w::BIGINT AS cumulative_unique, (count(*) OVER w - sum(f) OVER w)::BIGINT AS cumulative_duplicates, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW), 10) AS recent_mean
FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1)::INT AS f FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(s, d):
    x = ev.running_diversity(table(s, d, "events"), "user_id", "event_id", "props")
    return x.select("event_id", "cumulative_unique", "cumulative_duplicates", F.round("recent_mean", 10).alias("recent_mean"))


@query("q_keyset_page", "SELECT event_id, event_type FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 100")
def _(s, d):
    return ev.keyset_page(table(s, d, "events"), "event_id", 700, 100).select("event_id", "event_type")


@query("q_nested_topn", "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 64) ORDER BY event_id")
def _(s, d):
    return ev.latest_ascending(table(s, d, "events"), "event_id", 64).select("event_id", "event_type")


@query("q_latest_metric", "SELECT user_id, max(value) AS highest, arg_max(value, event_id) AS latest, max(event_id) AS step FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max("value").alias("highest"), F.max_by("value", "event_id").alias("latest"), F.max("event_id").alias("step"))


@query("q_payload_projection", "SELECT (json_extract(props, '$.k'))::BIGINT AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    x = table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return r6(x, "mean")


# results


def _stored(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("n_rows"), (F.col("p_retailprice") > 950).alias("feasible"))


@query("q_page_filter", "SELECT p_partkey::BIGINT AS id, p_name AS name, p_size AS n_rows, p_retailprice > 950 AS feasible FROM part WHERE p_size BETWEEN 5 AND 40 AND lower(p_name) LIKE '%red%' AND p_retailprice > 950 ORDER BY 1 LIMIT 50 OFFSET 20")
def _(s, d):
    return results.page(_stored(s, d), "RED", True, 5, 40, 20, 50)


@query("q_pattern_semi_join", "SELECT p_partkey::BIGINT AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def _(s, d):
    patterns = table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("long").alias("id"), F.col("l_returnflag").alias("pattern"))
    return results.with_pattern(_stored(s, d), patterns, "R").select("id", "name")


@query("q_orphan_check", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    details = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return results.orphans(details, table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("q_matrix_slice", f"WITH {EMB} SELECT row_index, column_index, round(num, 6) AS num FROM cells WHERE row_index IN (3, 17, 40, 41) AND column_index IN (0, 5, 63)")
def _(s, d):
    return r6(embedding_cells(s, d).filter(F.col("row_index").isin(3, 17, 40, 41) & F.col("column_index").isin(0, 5, 63)), "num").select("row_index", "column_index", "num")


@query("q_config_diff", """WITH c AS (SELECT DISTINCT s_nationkey AS pipeline, unnest(['sign', 'band']) AS path, unnest([(s_acctbal > 0)::VARCHAR, 'x']) AS value FROM supplier)
SELECT pipeline, path, value FROM c WHERE path IN (SELECT path FROM c GROUP BY path HAVING count(DISTINCT value) > 1)""")
def _(s, d):
    c = table(s, d, "supplier").select(F.col("s_nationkey").alias("pipeline"), F.explode(F.create_map(F.lit("sign"), (F.col("s_acctbal") > 0).cast("string"), F.lit("band"), F.lit("x"))).alias("path", "value")).distinct()
    return results.varying(c).select("pipeline", "path", "value")


@query("q_cached_cases", "SELECT sha256(o_orderkey::VARCHAR) AS fingerprint FROM orders WHERE o_orderstatus <> 'O'")
def _(s, d):
    o = table(s, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("fingerprint"), "o_orderstatus")
    return results.cached_cases(o.select("fingerprint"), o.filter("o_orderstatus = 'O'")).select("fingerprint")


from . import move_queries, search_queries, seed_queries  # noqa: E402, F401  these register their queries here
