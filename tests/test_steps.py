import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.operators import graph, ranks, steps


def _path(n=90, tracks=2, seed=3):
    rng = random.Random(seed)
    rows = []
    for t in range(tracks):
        x = y = 0.0
        for f in range(n + t):
            x, y = x + rng.uniform(-3, 6), y + rng.uniform(-5, 5)
            rows.append((t, 2 * f, x, y, rng.uniform(-0.2, 0.2)))
    return rows


SCHEMA = "t int, f long, x double, y double, rotation double"


def test_farthest_points(spark):
    rows = _path(40) + [(7, 1, 0.0, 0.0, 0.0), (8, 1, 0.0, 0.0, 0.0), (8, 2, 1.0, 0.0, 0.0)]
    want = set()
    for t in (0, 1, 7, 8):
        own = sorted((f, x, y) for k, f, x, y, _ in rows if k == t)
        if len(own) <= 5:
            want |= {(t, f) for f, _, _ in own}
            continue
        chosen = [len(own) - 1, 0]
        while len(chosen) < 5:
            near = [(-1.0 if i in chosen else min((own[i][1] - own[c][1]) ** 2 + (own[i][2] - own[c][2]) ** 2 for c in chosen)) for i in range(len(own))]
            chosen.append(int(np.argmax(near)))
        want |= {(t, own[i][0]) for i in chosen}
    assert {tuple(r) for r in steps.farthest_points(spark.createDataFrame(rows, SCHEMA), "t", "f", 5).collect()} == want
    assert {tuple(r) for r in steps.farthest_points(spark.createDataFrame(rows, SCHEMA), "t", "f", 1).where("t = 8").collect()} == {(8, 2)}


def test_intermediate_frames(spark):
    rows, budget = _path(60), 9
    df = spark.createDataFrame(rows, SCHEMA)
    keys = df.where("f % 10 = 0")
    got = {}
    for r in steps.intermediate_frames(df, keys, "t", "f", budget).collect():
        got.setdefault(r.t, set()).add(r.f)
    for t in (0, 1):
        own = sorted((f, x, y, r) for k, f, x, y, r in rows if k == t)

        def odd(i, own=own):
            if i in (0, len(own) - 1):
                return 0.0
            b, a, c = own[i - 1], own[i + 1], own[i]
            share = (c[0] - b[0]) / (a[0] - b[0])
            return math.hypot(c[1] - b[1] - share * (a[1] - b[1]), c[2] - b[2] - share * (a[2] - b[2]), (c[3] - b[3] - share * (a[3] - b[3])) * 100)

        free = [(own[i][0], odd(i)) for i in range(len(own)) if own[i][0] % 10]
        taken = [f for f, _ in sorted(free, key=lambda v: (-v[1], v[0]))[: -(-budget // 2)]]
        for k in range(budget - len(taken)):
            f = free[min(len(free) - 1, math.floor((k + 0.5) * len(free) / (budget - -(-budget // 2))))][0]
            taken += [f] if f not in taken else []
        for f, _ in free:
            taken += [f] if f not in taken and len(taken) < budget else []
        assert got[t] == set(taken) and len(got[t]) == budget


def test_choices_depend_on_the_last_one(spark):
    df = spark.createDataFrame([(1, f, s) for f, s in ((0, 0.9), (3, 0.9), (8, None), (9, 0.5), (12, 0.9), (17, 0.9))] + [(2, 5, 0.1)], "t int, f long, s double")
    assert sorted(tuple(r) for r in steps.context_frames(df, "t", "f", "s").collect()) == [(1, 0), (1, 8), (1, 9), (1, 17), (2, 5)]
    cells = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate((0.0, 6.0, 11.0, 16.5, 5.0, 30.0))], "g int, i int, x double, y double")
    assert sorted(r.i for r in steps.distinct_places(cells, "g", "i", 10.0).collect()) == [0, 2, 5]
    pts = lambda dx: [(dx + 10.0 * i, 0.0) for i in range(5)]
    frames = spark.createDataFrame([(1, "a", k, pts(dx)) for k, dx in enumerate((0.0, 1.0, 4.0, 5.0))] + [(1, "b", 9, pts(0.0)), (1, "b", 10, [])], "v int, r string, frame_id long, points array<struct<x:double,y:double>>")
    assert sorted(r.frame_id for r in steps.moved_enough(frames, ["v", "r"], 3.0).collect()) == [0, 2, 9]


def test_keyframes_keep_ends_and_bends(spark):
    rows = [(1, f, 3.0 * (f if f <= 100 else 200 - f), 0.0 if f <= 100 else 5.0, 0.0) for f in range(201)] + [(2, 4, 0.0, 0.0, 0.0)]
    got = sorted(r.f for r in graph.keyframes(spark.createDataFrame(rows, SCHEMA), "t", "f", 20.0).where("t = 1").collect())
    assert got[0] == 0 and got[-1] == 200 and len(got) < 40 and any(99 <= f <= 102 for f in got)


def test_exact_ranks(spark):
    rng = random.Random(1)
    values = {k: [rng.choice([0.0, -1.5, 1e-9, 3.0, rng.uniform(-5, 5), rng.gauss(0, 1e6)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 301), (None, 40))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("d", None), ("c", float("nan"))], "k string, v double")
    got = {r.k: r for r in ranks.exact_ranks(df, ["k"], "v", {"u": ranks.upper(0.95), "m": ranks.nearest(0.5), "l": ranks.lower(0.02)}).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        s, n = sorted(vs), len(vs)
        assert (got[k].n, got[k].u, got[k].m, got[k].l) == (n, s[min(n - 1, int(0.95 * n))], s[math.floor((n - 1) * 0.5 + 0.5)], s[math.floor((n - 1) * 0.02)])
    assert ranks.exact_ranks(df.where(F.lit(False)), ["k"], "v", {"u": ranks.upper(0.5)}).count() == 0
