import math

import numpy as np
import pytest

from fieldloom.kernels import returns
from fieldloom.operators import network


def _paths(n):
    """Three paths that cross tiles and places again; the first stands among much noise, the second steps between a few equal places."""
    rng = np.random.default_rng(3)
    dwell = np.concatenate([rng.normal(0, 0.6, (n, 2)) + 319, rng.normal(0, 120, (n // 2, 2))])
    hops = np.array([(0.0, 0.0), (3.0, 0.0), (-7.5, 4.0), (330.0, 9.0)])[rng.integers(0, 4, n)]
    turn = np.linspace(0, 9 * np.pi, n)
    loop = np.stack([50 * np.cos(turn), 45 * np.sin(turn)], axis=1) * (1 + turn[:, None] / 300)
    rows = [(t, 3 * f, float(x), float(y)) for t, p in enumerate((dwell, hops, loop)) for f, (x, y) in enumerate(p)]
    return [*rows, (0, 7, None, None), (4, 0, 1.0, 1.0), (4, 1, 500.0, 1.0)]


def _brute(rows, reach):
    found = {}
    for track in {r[0] for r in rows}:
        way, before, places = 0.0, None, []
        for _, f, x, y in sorted(r for r in rows if r[0] == track and r[2] is not None):
            way += math.sqrt((x - before[0]) ** 2 + (y - before[1]) ** 2) if before else 0.0
            before = x, y
            places.append((f, x, y, way))
        f, x, y, w = np.array(places).T
        for i in range(len(f)):
            d = np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2)
            good = np.flatnonzero((f > f[i]) & (w - w[i] >= 2 * reach) & (d < reach))
            if len(good):
                j = min(good, key=lambda k: (d[k], f[k]))
                region = track, math.floor((x[i] + x[j]) / 2 / (reach / 2)), math.floor((y[i] + y[j]) / 2 / (reach / 2))
                found[region] = min(found.get(region, (math.inf,)), (d[j], int(f[i]), int(f[j])))
    return sorted((region[0], a, b, round(d, 6)) for region, (d, a, b) in found.items())


def _got(spark, rows):
    path = spark.createDataFrame(rows, "track bigint, frame bigint, x double, y double")
    return network.overlap_checks(path, "track", "frame", 20.0)


@pytest.mark.parametrize("together", [100_000, 50])
def test_closest_returns_are_those_of_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(network, "TOGETHER", together)
    rows = _paths(600)
    got = sorted((r.track, r.reference, r.current, round(r.d, 6)) for r in _got(spark, rows).collect())
    assert got == _brute(rows, 20.0) and len(got) > 30


def test_rows_are_moved_a_few_times_only(spark):
    plan = _got(spark, _paths(10))._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 4  # one for each of four levels and more before


def test_dense_places_meet_few_others(monkeypatch):
    n, met = 20_000, []
    later = returns._Grid.later
    monkeypatch.setattr(returns._Grid, "later", lambda *a: met.append((r := later(*a))[1].sum()) or r)
    closest = returns._closest
    monkeypatch.setattr(returns, "_closest", lambda *a: met.append(-1) or closest(*a))
    x, y = np.random.default_rng(0).normal(0, 0.7, (2, n))
    way = np.cumsum(np.hypot(np.diff(x, prepend=x[0]), np.diff(y, prepend=y[0]))) + np.arange(n) * 1e-9
    zero = np.zeros(n, np.int64)
    a, b, d = returns.closest_later(zero, x, y, (zero - 40, zero - 40), way, np.arange(n), np.arange(n), 20.0, 40.0)
    compared = sum(m for before, m in zip(met, met[1:]) if before == -1)
    assert len(a) == len(set(a)) > n - 100 and compared < 200 * n
    for i in np.random.default_rng(1).integers(0, len(a), 50):
        far = np.where(way - way[a[i]] >= 40, np.hypot(x - x[a[i]], y - y[a[i]]), np.inf)
        assert far.argmin() == b[i] and abs(far.min() - d[i]) < 1e-12
