"""Alternating local search against a plain lineage."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from bimosaic.operators import local


def u(seed, *parts):
    return int(hashlib.md5(":".join([seed, *map(str, parts)]).encode()).hexdigest()[:13], 16) / (1 << 52)


def planned(parent, size, whole, minimum, change, seed):
    c, producer, last, sequence = parent
    turn = ("columns" if last.endswith("_row") else "rows") if producer == local.NAME else ("rows" if sequence % 2 == 0 else "columns")
    for side in (turn, "columns" if turn == "rows" else "rows"):
        grow, shrink = size[side] < whole[side], size[side] > minimum[side]
        if grow or shrink:
            if grow and u(f"{seed}:kind", c, sequence) >= change:
                return side, "swap"
            if grow and shrink:
                return side, "add" if u(f"{seed}:way", c, sequence) < 0.5 else "remove"
            return side, "add" if grow else "remove"
    return None


def test_lineages_alternate_and_moves_fit(spark):
    whole, minimum = {"rows": 9, "columns": 4}, {"rows": 2, "columns": 2}
    start = {0: (range(3), range(2)), 1: (range(9), range(4)), 2: (range(2), range(4)), 3: (range(9), range(2)), 4: (range(4, 9), range(1, 4)), 5: (range(2), range(2))}
    members = {s: {c: set(v[k]) for c, v in start.items()} for k, s in enumerate(local.SIDES)}
    lineage = {c: ("initializer", "draw") for c in start}
    frame = lambda s: spark.createDataFrame([(c, e) for c, v in members[s].items() for e in sorted(v)], f"candidate long, {local.SIDES[s]} long")
    universes = {s: spark.range(n).select(F.col("id").alias(local.SIDES[s])) for s, n in whole.items()}
    losses = {s: (lambda df, e=local.SIDES[s]: df.withColumn("loss", (F.col(e) * 7 % 5).cast("double"))) for s in whole}
    worst = lambda v: max(v, key=lambda e: (e * 7 % 5, e))
    best = lambda v: min(v, key=lambda e: (e * 7 % 5, e))
    for generation in range(3):
        parents = [(c, *lineage[c], c + generation) for c in start]
        df = spark.createDataFrame(parents, "candidate long, producer string, operation string, sequence long")
        out, plan = local.local_step(df, {s: frame(s) for s in whole}, universes, losses, (2, 2), 0.5, 64, f"g{generation}")
        got = {r["candidate"]: r["operation"] for r in plan.collect()}
        new = {s: {} for s in whole}
        for s, x in out.items():
            for r in x.collect():
                new[s].setdefault(r["candidate"], set()).add(r[1])
        for p in parents:
            c = p[0]
            size = {s: len(members[s][c]) for s in whole}
            side, operation = planned(p, size, whole, minimum, 0.5, f"g{generation}")
            assert got[c] == f"{operation}_{side[:-1]}"
            if lineage[c][0] == local.NAME and size != whole:
                other = "rows" if side == "columns" else "columns"
                assert lineage[c][1].endswith(f"_{other[:-1]}") or not (size[other] < whole[other] or size[other] > 2) or side == ("columns" if lineage[c][1].endswith("_row") else "rows")
            want = {s: set(members[s][c]) for s in whole}
            gone, come = worst(want[side]), best(set(range(whole[side])) - want[side]) if size[side] < whole[side] else None
            if operation != "add":
                want[side].remove(gone)
            if operation != "remove":
                want[side].add(come)
            assert {s: new[s][c] for s in whole} == want, (generation, c, operation, side)
            lineage[c] = (local.NAME, got[c])
        members = new
