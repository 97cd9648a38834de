import numpy as np
import pytest

from fieldloom.operators import spikes as s

SCORE = s.Field("score", ("v",), (-1.0,), (1.0,))
MOVING = s.Field("pose", ("x", "y"), (-1e7, -1e7), (1e7, 1e7), ((0, 1),), steps=True)


def _series(n=400, seed=0):
    return 0.8 + 0.003 * np.random.default_rng(seed).standard_normal(n)


def _faults(v, field=SCORE):
    v = v.reshape(len(v), -1)
    free = v[s.possible(v, field) & (s.equal_runs(v) < s.STUCK)]
    return set(np.flatnonzero(s.faults(v, field, [s.usual_scatter(free[:, list(p)], field.steps) for p in field.parts])))


def test_spikes_runs_and_levels():
    v = _series()
    v[50], v[100:103], v[200:] = 0.9, 0.7, v[200:] - 0.1
    assert _faults(v) == {50, 100, 101, 102}


def test_spikes_near_each_other():
    v = _series()
    v[60], v[62], v[64] = 0.9, 0.7, 0.95
    assert _faults(v) == {60, 62, 64}


@pytest.mark.parametrize("n,bad", [(5, False), (6, True), (9, True)])
def test_stuck(n, bad):
    v = _series()
    v[100 : 100 + n] = v[100]
    assert _faults(v) == (set(range(100, 100 + n)) if bad else set())


def test_impossible():
    v = _series()
    v[3], v[5], v[7], v[9] = np.nan, np.inf, 1.2, -1.01
    assert _faults(v) == {3, 5, 7, 9}


def test_moving_series():
    t = np.arange(300.0)
    v = np.stack([t * 2, np.where(t < 150, t, 300 - t)], axis=1) + np.random.default_rng(1).normal(0, 0.3, (300, 2))
    v[40] += 60
    assert _faults(v, MOVING) == {40}


def _table(n):
    rng = np.random.default_rng(4)
    v = 0.8 + 0.003 * rng.standard_normal(n)
    rows = [(1, i, i, float(v[i])) for i in range(n)]
    return rows


def test_chunks_change_nothing(spark, monkeypatch):
    n = 3000
    rows = _table(n)
    value = [r[3] for r in rows]
    for at, to in ((500, 0.95), (1023, 0.6), (1024, 0.6), (2047, 0.9), (2999, float("nan"))):
        value[at] = to
    for at in range(1020, 1020 - 9, -1):
        value[at] = 0.81  # stuck up to a border of chunks
    for at in (100, 102, 300, 301, 302, 303):
        value[at] = None
    for i, at in enumerate((99, 101, 103, 104, 105, 106)):
        value[at] = 0.5 + 0 * i  # equal but for missing ones between
    rows = [(1, i, i, v) for i, v in enumerate(value)]
    rows += rows[500:503] + [(None, 1, 1, 9.0), (1, None, 2, 9.0), (2, 7, 9001, 5.0), (2, 8, 9002, None)]
    df = spark.createDataFrame(rows, "v bigint, frame bigint, entry bigint, score double").selectExpr("*", "1 AS source", "2 AS chunk", "3 AS item")
    want = {500, 1023, 1024, 2047, 2999, 99, 101, 103, 104, 105, 106, 9001} | set(range(1012, 1021))
    for size in (s.CHUNK, 256):
        monkeypatch.setattr(s, "CHUNK", size)
        got = [(r.entry, r.field) for r in s.flag_faults(df, "v", "frame", "entry", [(SCORE, [df.score])]).collect()]
        assert {e for e, _ in got} == want and len(got) == len(want)


def test_nothing(spark):
    df = spark.createDataFrame([], "v bigint, frame bigint, entry bigint, score double")
    assert s.flag_faults(df, "v", "frame", "entry", [(SCORE, [df.score])]).count() == 0


def test_few_readings_and_still_courses():
    v = _series(7)
    v[3] = -0.9
    assert _faults(v) == {3} and _faults(v[1:6]) == {2}
    # Runs of three equal readings: most steps are 0.
    v = np.repeat(_series(20), 3)
    v[30] = -0.9
    assert _faults(v) == {30}
    # A course of short still runs that does not move but for one departure.
    v = np.array([0.5] * 5 + [0.9] + [0.5] * 5)
    assert _faults(v) == {5}
    assert _faults(np.array([0.5, 0.5])) == set() and _faults(np.array([0.5])) == set()


def test_sparse_source(spark):
    v = _series(40)
    v[20] = -0.9
    df = spark.createDataFrame([(1, i * 1_000_000, i, float(v[i])) for i in range(40)], "s int, t long, e long, v double")
    got = s.flag_faults(df, "s", "t", "e", [(SCORE, [df["v"]])]).collect()
    assert [(r.e, r.field) for r in got] == [(20, "score")]


def _many(seed=2):
    """Series of many lengths, spikes at their ends and in wide gaps among them, some of scatter 0 or without one."""
    rng = np.random.default_rng(seed)
    out = []
    for i, n in enumerate((0, 1, 2, 3, 5, 7, 40, 300, 3, 900)):
        v = np.stack([np.cumsum(rng.normal(1, 0.2, n)), rng.normal(0, 0.2, n)], axis=1)
        at = rng.random(n) < 0.1
        v[at] += rng.normal(0, 60, (int(at.sum()), 2))
        if n > 5:
            v[0], v[-1], v[n // 2 : n // 2 + 4] = 400.0, -400.0, (90.0, 90.0)
        if i == 6:
            v[:] = v[0]
            v[20] += 50
        out.append(v)
    return out


def test_series_judged_together_are_those_judged_alone():
    series = _many()
    scale = np.array([[s.usual_scatter(v, True)] for v in series])
    alone = [s.faults(v, MOVING, r) for v, r in zip(series, scale)]
    together = s.faults(np.concatenate(series), MOVING, scale, np.array([len(v) for v in series]))
    assert (together == np.concatenate(alone)).all() and together.sum() > 60


def test_later_rounds_judge_only_what_has_changed(monkeypatch):
    v = np.concatenate([_series(4000, seed=i) for i in range(5)])
    v[::97] += 0.05
    judged = []
    median = s._Series.running_median
    monkeypatch.setattr(s._Series, "running_median", lambda of, values, width, rows: judged.append(len(rows)) or median(of, values, width, rows))
    assert _faults(v) >= set(range(97, len(v) - 1, 97))
    assert len(judged) >= 5 and sum(judged) < 3 * len(v)  # each round was over all rows before
