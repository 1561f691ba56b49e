"""Association tests, survival, multiplicity and paired summaries as grouped DataFrame plans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues


def contingency(df: DataFrame, group: str, exposed: str, event: str) -> DataFrame:
    """group, a, b, c, d: rows with exposed/event both, only exposed, only event, neither."""
    e, v = F.col(exposed) == 1, F.col(event) == 1
    return df.groupBy(group).agg(F.count_if(e & v).alias("a"), F.count_if(e & ~v).alias("b"), F.count_if(~e & v).alias("c"), F.count_if(~e & ~v).alias("d"))


def fisher(tables: DataFrame) -> DataFrame:
    """``tables`` with odds_ratio (null where not finite) and the two-sided p_value."""
    odds = F.col("a") * F.col("d") / F.nullif(F.col("b") * F.col("c"), F.lit(0))
    return tables.withColumn("odds_ratio", odds).withColumn("p_value", pvalues.fisher("a", "b", "c", "d"))


def mann_whitney(df: DataFrame, group: str, member: str, value: str, with_ties: bool = False) -> DataFrame:
    """group, n1, n2, u, rank_biserial, median_in, median_out; average ranks from counts per value, so ties need no big peer group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_if(F.col(member) == 1).alias("m"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", below + (F.col("n") + 1) / 2)
    s = ranked.groupBy(group).agg(F.sum(F.col("m") * F.col("rank")).alias("r1"), F.sum("m").alias("n1"), (F.sum("n") - F.sum("m")).alias("n2"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    var = F.nullif(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0))), F.lit(0.0))
    z = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)) / F.sqrt(var)
    m = df.groupBy(group).agg(F.median(F.when(F.col(member) == 1, F.col(value))).alias("median_in"), F.median(F.when(F.col(member) == 0, F.col(value))).alias("median_out"))
    out = s.withColumn("rank_biserial", 2 * F.col("u") / F.nullif(F.col("n1") * F.col("n2"), F.lit(0)) - 1).withColumn("z", z).join(m, group)
    return out.select(group, "n1", "n2", "u", "rank_biserial", "z", "median_in", "median_out", *(["ties"] if with_ties else []))


def mann_whitney_p(df: DataFrame, group: str, member: str, value: str, small: int = 8, most: int = 10_000) -> DataFrame:
    """``mann_whitney`` with p_value: exact without ties where the smaller side has at most ``small`` values and n1 * n2 is at most ``most``,
    else by the normal approximation with continuity correction; null where a side is empty or all values are equal."""
    x = mann_whitney(df, group, member, value, with_ties=True)
    exact = (F.col("ties") == 0) & (F.least("n1", "n2").between(1, small)) & (F.col("n1") * F.col("n2") <= most)
    return x.withColumn("p_value", F.coalesce(pvalues.rank_sum("n1", "n2", F.when(exact, F.col("u"))), pvalues.normal_two_sided("z"))).drop("ties")


def chi_square(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, statistic, degrees, cramers_v of the contingency table of x and y, no continuity correction."""
    o = df.groupBy(group, x, y).agg(F.count(F.lit(1)).alias("o"))
    rx = df.groupBy(group, x).agg(F.count(F.lit(1)).alias("rx"))
    ry = df.groupBy(group, y).agg(F.count(F.lit(1)).alias("ry"))
    n = rx.groupBy(group).agg(F.sum("rx").alias("n"), F.count(F.lit(1)).alias("kx"))
    k = ry.groupBy(group).agg(F.count(F.lit(1)).alias("ky"))
    # Every cell of the table, empty ones too: no difference of large sums, so an exact 0 stays 0.
    cells = rx.join(ry, group).join(n.select(group, "n"), group).join(o, [group, x, y], "left")
    e = F.col("rx") * F.col("ry") / F.col("n")
    s = cells.groupBy(group).agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, F.lit(2)) / e).alias("statistic"))
    out = s.join(n, group).join(k, group).withColumn("degrees", (F.col("kx") - 1) * (F.col("ky") - 1))
    v = F.sqrt(F.col("statistic") / (F.col("n") * F.nullif(F.least(F.col("kx"), F.col("ky")) - 1, F.lit(0))))
    return out.select(group, "statistic", "degrees", v.alias("cramers_v"))


def log_rank(df: DataFrame, time: str, event: str, member: str, group: str) -> DataFrame:
    """group, observed, expected, variance, statistic over the distinct event times; counts per time first, then running totals."""
    t = df.groupBy(group, time).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("d"), F.sum(member).alias("n1"), F.sum(F.col(member) * F.col(event)).alias("d1"))
    later = Window.partitionBy(group).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("at", F.sum("n").over(later)).withColumn("at1", F.sum("n1").over(later)).filter("d > 0")
    e = F.col("d") * F.col("at1") / F.col("at")
    v = F.when(F.col("at") > 1, e * (1 - F.col("at1") / F.col("at")) * (F.col("at") - F.col("d")) / (F.col("at") - 1)).otherwise(0.0)
    out = t.groupBy(group).agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    return out.withColumn("statistic", F.pow(F.col("observed") - F.col("expected"), F.lit(2)) / F.nullif("variance", F.lit(0.0)))


def kaplan_meier(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """group, median_survival: the first time at which survival is at most one half (null if never)."""
    t = df.groupBy(group, time).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("d"))
    t = t.withColumn("at", F.sum("n").over(Window.partitionBy(group).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    up = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.max((F.col("d") == F.col("at")).cast("int")).over(up)
    log = F.sum(F.when(F.col("d") < F.col("at"), F.ln(1 - F.col("d") / F.col("at")))).over(up)
    t = t.withColumn("s", F.when(gone == 1, 0.0).otherwise(F.exp(log)))
    return t.groupBy(group).agg(F.min(F.when(F.col("s") <= 0.5 + 1e-12, F.col(time))).alias("median_survival"))


def benjamini_hochberg(p: DataFrame, key: str, family: str | None = None) -> DataFrame:
    """``q_value`` within a family: least p * m / rank among the ranks from its own on."""
    part = [family] if family else [F.lit(0)]
    whole, order = Window.partitionBy(*part), Window.partitionBy(*part).orderBy("p_value", key)
    r = p.withColumn("__m", F.count(F.lit(1)).over(whole)).withColumn("__r", F.row_number().over(order))
    r = r.withColumn("__q", F.col("p_value") * F.col("__m") / F.col("__r"))
    suffix = Window.partitionBy(*part).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.withColumn("q_value", F.least(F.lit(1.0), F.min("__q").over(suffix))).drop("__m", "__r", "__q")


def holm(p: DataFrame, key: str, family: str | None = None) -> DataFrame:
    part = [family] if family else [F.lit(0)]
    order = Window.partitionBy(*part).orderBy("p_value", key)
    step = F.col("p_value") * (F.count(F.lit(1)).over(Window.partitionBy(*part)) - F.row_number().over(order) + 1)
    r = p.withColumn("__s", F.least(F.lit(1.0), step))
    return r.withColumn("adjusted", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__s")


def log_rank_p(df: DataFrame, time: str, event: str, member: str, group: str) -> DataFrame:
    """``log_rank`` with p_value, chi-square with one degree; null without variance."""
    return log_rank(df, time, event, member, group).withColumn("p_value", pvalues.chi_square("statistic", F.lit(1)))


def wilcoxon_p(deltas: DataFrame, group: str, delta: str, small: int = 50) -> DataFrame:
    """``wilcoxon`` with p_value: exact without ties for at most ``small`` differences, else by the normal approximation with tie correction."""
    x = wilcoxon(deltas, group, delta, with_ties=True)
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)
    exact = F.when((F.col("ties") == 0) & (F.col("n") <= small), F.col("w_plus"))
    return x.withColumn("z", z).withColumn("p_value", F.coalesce(pvalues.signed_rank("n", exact), pvalues.normal_two_sided("z"))).drop("ties")


def wilcoxon(deltas: DataFrame, group: str, delta: str, with_ties: bool = False) -> DataFrame:
    """group, n, w_plus, w_minus, rank_biserial of the signed ranks; zero differences are left out, ties share average ranks."""
    d = deltas.filter(F.abs(delta) > 1e-8).withColumn("__a", F.round(F.abs(delta), 12))
    counts = d.groupBy(group, "__a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(delta) > 0).alias("plus"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = counts.withColumn("rank", below + (F.col("n") + 1) / 2)
    out = r.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("plus")) * F.col("rank")).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    out = out if with_ties else out.drop("ties")
    return out.withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))


def paired_deltas(results: DataFrame, keys: list[str], variant: str, baseline: str, value: str) -> DataFrame:
    """keys, variant, delta: each variant against the baseline with the same keys."""
    base = results.filter(F.col(variant) == baseline).select(*keys, F.col(value).alias("__base"))
    return results.filter(F.col(variant) != baseline).join(base, keys).select(*keys, variant, (F.col(value) - F.col("__base")).alias("delta"))


def grouped_with_all(df: DataFrame, keys: list[str], sub: str, value: str) -> DataFrame:
    """Mean of ``value`` per keys and ``sub``, and a row ALL per keys, in one pass (grouping sets)."""
    name = F.when(F.grouping(sub) == 1, "ALL").otherwise(F.col(sub))
    sets = [[F.col(k) for k in keys], [*map(F.col, keys), F.col(sub)]]
    return df.groupingSets(sets, *map(F.col, [*keys, sub])).agg(name.alias("pattern"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*keys, "pattern", "mean", "n")


def summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, sd (0 for one value), median, minimum, maximum."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.median(value).alias("median"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def bootstrap_mean(df: DataFrame, group: str, value: str, draws: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """group, low, high: percentile interval of the mean of a group of summary values (one per dataset and seed, so small)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].sort_values().to_numpy(float)
        means = x[np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))].mean(1)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "low": [low], "high": [high]})

    return df.select(group, value).dropna().groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, low double, high double")


def cox_binary(df: DataFrame, time: str, event: str, member: str, group: str) -> DataFrame:
    """group, hazard_ratio of members by Newton steps, ties after Breslow; 1 where the information vanishes (separated groups, no events). Works on counts per time, not on rows."""
    t = df.groupBy(group, time).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("d"), F.sum(member).alias("n1"), F.sum(F.col(member) * F.col(event)).alias("d1"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, ascending=False)
        at1, at0 = pdf["n1"].cumsum().to_numpy(float), (pdf["n"] - pdf["n1"]).cumsum().to_numpy(float)
        d, d1, b = pdf["d"].to_numpy(float), pdf["d1"].to_numpy(float), 0.0
        for _ in range(50):
            weight = at1 * math.exp(min(max(b, -40.0), 40.0))
            p = weight / np.maximum(weight + at0, 1e-300)
            information = (d * p * (1 - p)).sum()
            if information <= 1e-12:  # groups that no hazard ratio tells apart, or that none can
                return pd.DataFrame({group: [pdf[group].iloc[0]], "hazard_ratio": [1.0]})
            step = (d1 - d * p).sum() / information
            b += step
            if abs(step) < 1e-9:
                break
        return pd.DataFrame({group: [pdf[group].iloc[0]], "hazard_ratio": [math.exp(min(max(b, -40.0), 40.0))]})

    return t.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, hazard_ratio double")
