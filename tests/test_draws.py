from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bimosaic.functions import digests
from bimosaic.operators import search, seeds


def head(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def test_heads_equal_hashlib():
    starts = ["", "a:", "draw-1:7:", "draw-1:123456:", "é:-5:", "s" * 50 + ":1:", "s" * 70 + ":"]
    ends = ["", "0", "-12", "123456789", "9" * 19, *map(str, range(95, 105))]
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), 1 << digests.BITS)
    low[2], high[3] = 1 << 51, 1 << 50
    i, j, u = digests.heads_between([s.encode() for s in starts], [e.encode() for e in ends], low, high)
    expected = {(a, b): head(s + e) for a, s in enumerate(starts) for b, e in enumerate(ends) if low[a] <= head(s + e) < high[a]}
    assert dict(zip(zip(i.tolist(), j.tolist()), u.tolist())) == expected and len(u) == len(expected)


@pytest.mark.parametrize("spread,more,block", [(4, 8, 2048), (0, 0, 7), (0, -3, 2048)])
def test_few_pairs_are_written_and_none_is_missed(spark, monkeypatch, spread, more, block):
    """With no more than ``size`` expected below the limit, or fewer, candidates fall short of it and take what lies above."""
    written = []

    def counted(df, name):
        out = cut(df, name)
        written.append(out.count())
        return out

    cut = seeds.cut
    monkeypatch.setattr(seeds, "cut", counted)
    monkeypatch.setattr(seeds, "_SPREAD", spread)
    monkeypatch.setattr(seeds, "_MORE", more)
    monkeypatch.setattr(seeds, "_BLOCK", block)
    candidates = spark.range(40).select(F.col("id").alias("candidate"), (F.col("id") % 2).alias("stratum"), (F.col("id") % 6).alias("size"))
    elements = spark.range(-3, 3000).select((F.col("id") % 40 % 3).alias("stratum"), F.col("id").alias("row_index"))
    got: dict[int, set[int]] = {}
    for r in seeds.random_members(candidates, elements, "row_index").collect():
        got.setdefault(r.candidate, set()).add(r.row_index)
    own = {}
    for r in elements.collect():
        own.setdefault(r.stratum, []).append(r.row_index)
    expected = {c: set(sorted(own[c % 2], key=lambda e: (head(f"draw-1:{c}:{e}"), e))[: c % 6]) for c in range(40) if c % 6}
    assert got == expected
    assert written and sum(written) < 40 * 25  # of some 40,000 pairs


def test_parents_by_brute_force(spark):
    members = [(i, i % 3, i * 7 % 11 / 10, str(i % 5)) for i in range(400)] + [(5, 2, 0.05, "x")]
    m = spark.createDataFrame(members, "id long, cell long, loss double, signature string")
    asked = spark.range(60).withColumnRenamed("id", "request")
    for guided in (True, False):
        got = {r.request: r.id for r in search.parents(asked, m, 4, guided).collect()}
        expected = {}
        for q in range(60):
            cell = int(head(f"parent-1:cell:{q}") / 2.0**52 * 3)
            pool = sorted((x for x in members if x[1] == cell), key=lambda x: (head(f"parent-1:{q}:{x[0]}"), x[0]))[:4]
            expected[q] = min(pool, key=lambda x: (x[2], x[3], x[0]))[0] if guided else pool[0][0]
        assert got == expected
