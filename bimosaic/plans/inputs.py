"""Relations that the registered queries derive from the given tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import matrix

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = matrix.array_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return cells.withColumn("num", F.when((F.col("row_index") * 7 + F.col("column_index") * 13) % 31 != 0, F.col("num")))


def label_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("candidate"), F.col("vec_id").cast("long").alias("row_index"))
    columns = spark.range(64).select((F.col("id") % 10).alias("candidate"), F.col("id").cast("int").alias("column_index"))
    return rows, columns


EMB = """
cells AS (SELECT vec_id::BIGINT AS row_index, c::INT AS column_index,
  CASE WHEN (vec_id * 7 + c * 13) % 31 <> 0 THEN embedding[c + 1]::DOUBLE END AS num FROM embeddings, (SELECT unnest(range(64)) AS c)),
crows AS (SELECT label::BIGINT AS candidate, vec_id::BIGINT AS row_index FROM embeddings),
ccols AS (SELECT (c % 10)::BIGINT AS candidate, c::INT AS column_index FROM range(64) t(c)),
inside AS (SELECT candidate, row_index, column_index, num FROM cells JOIN ccols USING (column_index) JOIN crows USING (candidate, row_index)),
stats AS (SELECT column_index, count(num) AS n, quantile_cont(num, 0.05) AS p05, quantile_cont(num, 0.5) AS median, quantile_cont(num, 0.95) AS p95,
  quantile_cont(num, 0.95) - quantile_cont(num, 0.05) AS rr FROM cells GROUP BY column_index)
"""
FIT = EMB + """,
par AS (SELECT candidate, column_index, median(num) AS parameter, count(num) AS support FROM inside GROUP BY ALL HAVING count(num) >= greatest(2, ceil(count(*) * 0.8e0))),
fits AS (SELECT candidate, column_index, parameter, support, avg(CASE WHEN rr > 1e-12 THEN least(1e0, abs(num - parameter) / rr) ELSE (abs(num - parameter) > 1e-12)::INT END) AS error
  FROM inside JOIN par USING (candidate, column_index) JOIN stats USING (column_index) WHERE num IS NOT NULL GROUP BY ALL)
"""
AUC = """,
flagged AS (SELECT ccols.candidate, column_index, cells.row_index, num, (crows.row_index IS NOT NULL)::INT AS local
  FROM cells JOIN ccols USING (column_index) LEFT JOIN crows ON crows.candidate = ccols.candidate AND crows.row_index = cells.row_index),
resid AS (SELECT candidate, column_index, {r} AS r, local FROM flagged {join} WHERE {r} IS NOT NULL),
rk AS (SELECT *, coalesce(sum(local) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-12 PRECEDING), 0) - coalesce(sum(local) OVER (w RANGE BETWEEN 1e-12 PRECEDING AND 1e-12 PRECEDING), 0) AS lo,
  coalesce(sum(local) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-12 FOLLOWING), 0) AS up FROM resid WINDOW w AS (PARTITION BY candidate, column_index ORDER BY r)),
auc AS (SELECT candidate, column_index, sum(CASE WHEN local = 0 THEN lo + 0.5e0 * (up - lo) END) / (sum(local) * sum(1 - local))::DOUBLE AS contrast FROM rk GROUP BY ALL)
"""


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    c = c.withColumn("bal", F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal"))).withColumn("seg", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")))
    c = c.withColumn("empty", F.lit(None).cast("double")).withColumn("third", F.when(F.col("c_custkey") % 4 != 0, F.when(F.col("c_nationkey") % 3 == 0, "true").otherwise("false")))
    numeric = matrix.numeric_cells(c, "c_custkey", {0: "bal", 1: "empty"})
    discrete = matrix.discrete_cells(c, "c_custkey", {2: ("seg", SEGMENTS), 3: ("third", ["false", "true"])})
    return numeric.unionByName(discrete)


def nation_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("candidate"), F.col("c_custkey").cast("long").alias("row_index"))
    columns = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("candidate"), F.explode(F.array(F.lit(2), F.lit(3))).alias("column_index"))
    return rows, columns


CUST = """
cells AS (
  SELECT c_custkey::BIGINT AS row_index, 0 AS column_index, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS num, NULL::INT AS code FROM customer
  UNION ALL SELECT c_custkey, 1, NULL, NULL FROM customer
  UNION ALL SELECT c_custkey, 2, NULL, CASE WHEN c_custkey % 11 <> 0 THEN list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 END FROM customer
  UNION ALL SELECT c_custkey, 3, NULL, CASE WHEN c_custkey % 4 <> 0 THEN (c_nationkey % 3 = 0)::INT END FROM customer),
crows AS (SELECT c_nationkey::BIGINT AS candidate, c_custkey::BIGINT AS row_index FROM customer),
ccols AS (SELECT n_nationkey::BIGINT AS candidate, c AS column_index FROM nation, (SELECT unnest([2, 3]) AS c)),
freq AS (SELECT column_index, code, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY column_index)::DOUBLE AS frequency, count(*) OVER (PARTITION BY column_index) AS cardinality FROM cells WHERE code IS NOT NULL GROUP BY column_index, code),
modes AS (SELECT column_index, code AS mode FROM freq QUALIFY row_number() OVER (PARTITION BY column_index ORDER BY n DESC, code) = 1)
"""
FITD = CUST + """,
inside AS (SELECT candidate, row_index, column_index, code FROM cells JOIN ccols USING (column_index) JOIN crows USING (candidate, row_index)),
cnt AS (SELECT candidate, column_index, code, count(*) AS n FROM inside WHERE code IS NOT NULL GROUP BY ALL),
sup AS (SELECT candidate, column_index, count(code) AS support FROM inside GROUP BY ALL HAVING count(code) >= greatest(2, ceil(count(*) * 0.7e0))),
top AS (SELECT candidate, column_index, code AS mode, n FROM cnt QUALIFY row_number() OVER (PARTITION BY candidate, column_index ORDER BY n DESC, code) = 1),
card AS (SELECT column_index, count(*) AS g FROM freq GROUP BY column_index),
fits AS (SELECT candidate, column_index, mode, support, CASE WHEN g > 1 THEN (1 - n / support::DOUBLE) / (1 - 1 / g::DOUBLE) ELSE 0 END AS error FROM top JOIN sup USING (candidate, column_index) JOIN card USING (column_index))
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records: one candidate for each customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("cell"), F.round((F.col("c_acctbal") + 1000) / 11000, 3).alias("coherence"),
        ((k * 7919) % 1000 / F.lit(1000.0)).alias("contrast"), (k % 97 + 2).alias("n_rows"), (k % 13 + 2).alias("n_columns"),
        F.sha2((k % 700).cast("string"), 256).alias("signature"), (k % 5).alias("generation"), ((k % 10 - 6) / F.lit(10.0)).alias("violation"),
    ).withColumn("loss1", F.col("coherence")).withColumn("loss2", 1 - F.col("contrast"))


SCORED = """
scored AS (SELECT *, coherence AS loss1, 1 - contrast AS loss2 FROM (SELECT c_custkey::BIGINT AS id, c_nationkey::BIGINT AS cell, round((c_acctbal + 1000) / 11000, 3) AS coherence,
  ((c_custkey * 7919) % 1000) / 1000e0 AS contrast, c_custkey % 97 + 2 AS n_rows, c_custkey % 13 + 2 AS n_columns,
  sha256((c_custkey % 700)::VARCHAR) AS signature, c_custkey % 5 AS generation, (c_custkey % 10 - 6) / 10e0 AS violation FROM customer))
"""


def memberships(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Rows and columns of reference biclusters (nations) and of detected ones (customer keys modulo 23), and nested ones (prefixes)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    twelve = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("column_index")
    ref = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), twelve)
    det = spark.range(23).select("id", twelve)
    nested = c.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("id"), k.alias("row_index"))
    return {
        "ref_rows": c.select(F.col("c_nationkey").cast("long").alias("id"), k.alias("row_index")),
        "det_rows": c.select((k % 23).alias("id"), k.alias("row_index")),
        "ref_columns": ref.filter((F.col("column_index") + F.col("id")) % 3 == 0),
        "det_columns": det.filter((F.col("column_index") * F.col("id")) % 4 < 2),
        "nested_rows": nested.filter(F.col("row_index") % 64 < F.pow(F.lit(2), F.col("id"))),
        "nested_columns": spark.range(1, 7).select("id", twelve).filter(F.col("column_index") < F.col("id") + 3),
    }


MEMBERS = """
ref_rows AS (SELECT c_nationkey::BIGINT AS id, c_custkey::BIGINT AS row_index FROM customer),
det_rows AS (SELECT (c_custkey % 23)::BIGINT AS id, c_custkey::BIGINT AS row_index FROM customer),
ref_columns AS (SELECT n_nationkey::BIGINT AS id, c::INT AS column_index FROM nation, range(12) t(c) WHERE (c + n_nationkey) % 3 = 0),
det_columns AS (SELECT i::BIGINT AS id, c::INT AS column_index FROM range(23) u(i), range(12) t(c) WHERE (c * i) % 4 < 2),
rj AS (SELECT a.id AS a, b.id AS b, count(*) AS both, count(*)::DOUBLE / (any_value(na.n) + any_value(nb.n) - count(*)) AS row_jaccard FROM ref_rows a JOIN det_rows b USING (row_index)
  JOIN (SELECT id, count(*) AS n FROM ref_rows GROUP BY id) na ON na.id = a.id JOIN (SELECT id, count(*) AS n FROM det_rows GROUP BY id) nb ON nb.id = b.id GROUP BY a.id, b.id),
cj AS (SELECT a.id AS a, b.id AS b, count(*) AS both, count(*)::DOUBLE / (any_value(na.n) + any_value(nb.n) - count(*)) AS column_jaccard FROM ref_columns a JOIN det_columns b USING (column_index)
  JOIN (SELECT id, count(*) AS n FROM ref_columns GROUP BY id) na ON na.id = a.id JOIN (SELECT id, count(*) AS n FROM det_columns GROUP BY id) nb ON nb.id = b.id GROUP BY a.id, b.id),
pairs AS (SELECT a, b, row_jaccard, column_jaccard, sqrt(row_jaccard * column_jaccard) AS similarity, rj.both AS shared_rows, cj.both AS shared_columns FROM rj JOIN cj USING (a, b)),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, row_jaccard DESC, column_jaccard DESC, b DESC) = 1)
"""
