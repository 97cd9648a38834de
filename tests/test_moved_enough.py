import numpy as np

from fieldloom.operators import steps


def _near(own, kept, least):
    """By comparison with every frame kept."""
    for other in kept:
        nearest = np.abs(own[:, None] - other[None, :]).min(axis=1)
        if np.partition(nearest, len(own) // 2)[len(own) // 2] < least:
            return True
    return False


def test_equal_to_comparing_with_every_frame(spark):
    rng = np.random.default_rng(5)
    views = [rng.uniform(-40, 400, (rng.integers(1, 30), 2)) for _ in range(60)]
    rows, odd = [], [np.nan, np.inf, -np.inf, 0.0, 3.0, 6.0]
    for f in range(900):
        p = views[rng.integers(len(views))] + rng.normal(0, rng.choice([0.3, 1.5, 3.0]), 2)
        p = np.round(p + rng.normal(0, 0.5, p.shape), 1)[rng.permutation(len(p))[: rng.integers(1, len(p) + 1)]]
        if f % 9 == 0:
            p[rng.integers(len(p)), rng.integers(2)] = odd[f // 9 % 6]
        rows.append((1 + f % 2, f, [tuple(map(float, q)) for q in p]))
    df = spark.createDataFrame(rows, "video_id long, frame_id long, points array<struct<x:double,y:double>>")
    got = {(r.video_id, r.frame_id) for r in steps.moved_enough(df, ["video_id"], 3.0).collect()}
    want = set()
    with np.errstate(invalid="ignore"):
        for v in (1, 2):
            kept = []
            for video, f, p in rows:
                own = np.array([q[0] for q in p]) + 1j * np.array([q[1] for q in p])
                if video == v and not _near(own, kept, 3.0):
                    kept.append(own)
                    want.add((v, f))
    assert got == want and len(want) > 200


def test_work_does_not_grow_with_the_frames_kept(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(1, f, [tuple(map(float, q)) for q in rng.uniform(0, 5000, (6, 2))]) for f in range(4000)]
    df = spark.createDataFrame(rows, "video_id long, frame_id long, points array<struct<x:double,y:double>>")
    compared = []

    def choose_all(frames, track, order, start, choose):
        state, real = start(), np.abs
        monkeypatch.setattr(steps.np, "abs", lambda a: compared.append(np.size(a)) or real(a))
        for r in sorted(frames.collect(), key=lambda r: r.frame_id):
            _, state = choose(state, {"px": [np.array(r.px)], "py": [np.array(r.py)]}, 0)
        monkeypatch.setattr(steps.np, "abs", real)
        return frames

    monkeypatch.setattr(steps, "chosen_in_order", choose_all)
    steps.moved_enough(df, ["video_id"], 3.0)
    # Every frame used to be compared with every one kept: 36 distances for each of 8 million pairs.
    assert sum(compared) < 40e6
