"""Tail probabilities as vectorised UDFs over aggregated rows; Spark SQL has no log-gamma, error function or incomplete gamma."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: all tables with the same margins that are no likelier than this one."""
    r, col, n = a + b, a + c, a + b + c + d
    p = lambda x: math.exp(log_choose(r, x) + log_choose(n - r, col - x) - log_choose(n, col))
    own = p(a)
    return min(1.0, math.fsum(q for x in range(max(0, col - (n - r)), min(r, col) + 1) if (q := p(x)) <= own * (1 + 1e-7)))


def chi_square_tail(x: float, k: float) -> float:
    """Upper tail of chi-square with k degrees: regularised incomplete gamma by series or continued fraction."""
    if x <= 0 or k <= 0:
        return 1.0
    s, z = k / 2, x / 2
    front = math.exp(s * math.log(z) - z - math.lgamma(s))
    if z < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = z + 1 - s, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def signed_rank_tail(n: int, w: int) -> float:
    """Two-sided exact p of a signed-rank sum ``w`` of n ranks without ties: all 2 ** n choices of signs counted by sum."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(counts) - 1, rank - 1, -1):
            counts[s] += counts[s - rank]
    low = min(w, len(counts) - 1 - w)
    return min(1.0, 2 * sum(counts[: low + 1]) / 2**n)


def rank_sum_tail(n1: int, n2: int, u: int) -> float:
    """Two-sided exact p of a Mann-Whitney ``u`` without ties: the choices of n1 ranks counted by u (coefficients of a Gaussian binomial)."""
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for s in range(len(counts) - 1, n2 + i - 1, -1):
            counts[s] -= counts[s - n2 - i]
        for s in range(i, len(counts)):
            counts[s] += counts[s - i]
    low = min(u, n1 * n2 - u)
    return min(1.0, 2 * sum(counts[: low + 1]) / math.comb(n1 + n2, n1))


@F.pandas_udf(T.DoubleType())
def signed_rank(n: pd.Series, w: pd.Series) -> pd.Series:
    """Null where w is null."""
    return pd.Series([None if pd.isna(b) else signed_rank_tail(int(a), round(b)) for a, b in zip(n, w, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def rank_sum(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Null where u is null."""
    return pd.Series([None if pd.isna(c) else rank_sum_tail(*sorted((int(a), int(b))), round(c)) for a, b, c in zip(n1, n2, u, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi_square(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else chi_square_tail(float(v), float(n)) for v, n in zip(x, k, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))
