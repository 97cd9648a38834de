import math
import random

from pyspark.sql import functions as F

from fieldloom.llm import overlap, subset

POINT = "array<struct<grid_col: int, grid_row: int, x: double, y: double, confidence: double>>"
SCHEMA = f"frame_id bigint, video_id bigint, role string, enabled boolean, points {POINT}"


def _grid(x, y, n, m, turn=0.1, step=50.0, noise=0.0, rng=None, drop=0):
    rng = rng or random.Random(0)
    c, s = math.cos(turn) * step, math.sin(turn) * step
    points = [(i, j, x + c * i - s * j + rng.uniform(-noise, noise), y + s * i + c * j + rng.uniform(-noise, noise), None) for i in range(n) for j in range(m)]
    rng.shuffle(points)
    return points[drop:]


def _brute(rows):
    out = set()
    for a in rows:
        for b in rows:
            if a[2] and b[2] and a[2].strip().lower() == "train" and b[2].strip().lower() == "validation" and a[0] != b[0]:
                p, q = [[(u[2], u[3]) for u in (r[4] or [])] for r in (a, b)]
                if min(len(p), len(q)) < 9:
                    continue
                part = lambda u, v: sum(any(math.dist(k, h) <= 1.5 for h in v) for k in u) * 10 >= 9 * len(u)
                if len(p) >= len(q) and part(p, q) or len(q) >= len(p) and part(q, p):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(90):
        x, y, t = rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(-0.3, 0.3)
        for _ in range(rng.randint(2, 4)):
            role = rng.choice(["train", " Train", "validation", "VALIDATION", None, "other"])
            rows.append((len(rows), k, role, None, _grid(x, y, 5, rng.choice([4, 5]), t, noise=rng.choice([0, 0.5, 0.9]), rng=rng, drop=rng.choice([0, 0, 1, 2, 3]))))
    rows += [(900, 1, "train", True, None), (901, 1, "validation", True, []), (902, 1, "train", True, _grid(0, 0, 2, 4)), (903, 1, "validation", True, _grid(0, 0, 2, 4))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows)
    assert len(want) > 10
    found = [tuple(r) for r in overlap.frame_pairs(df.unionAll(df.limit(20)).withColumns({"a": F.lit(1), "hash": F.lit(2), "pts": F.lit(3)})).collect()]
    assert set(found) == want and len(found) == len(want)
    report = overlap.overlap_report(df).agg(F.sum("pairs")).first()[0]
    assert report == 2 * len(want)
    assert overlap.frame_pairs(df.limit(0)).count() == 0


def test_points_that_are_no_positions_do_not_count(spark):
    good = _grid(0, 0, 3, 3)
    bad = [(0, 0, None, 1.0, 1.0), (0, 0, float("nan"), 1.0, 1.0), (0, 0, float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame([(1, 1, "train", True, good + bad), (2, 1, "validation", None, good)], SCHEMA)
    assert [tuple(r) for r in overlap.frame_pairs(df).collect()] == [(1, 2)]


def test_subset_prefers_the_rare(spark):
    rng = random.Random(2)
    rows = [(i, 1, "train", True, _grid(100, 100, 4, 4, noise=0.3, rng=rng)) for i in range(300)]
    rows += [(1000 + i, 1, "train", True, _grid(rng.uniform(0, 5000), rng.uniform(0, 5000), 4, 4, rng.uniform(-1, 1))) for i in range(100)]
    rows += [(1, 1, "train", True, rows[1][4]), (2000, 1, "train", None, rows[1][4]), (2001, 1, "train", True, None), (2002, 1, None, True, _grid(0, 0, 1, 3)), (None, 1, "train", True, rows[1][4])]
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = subset.varied_frames(df, 60).collect()
    ids = {r.frame_id for r in chosen}
    assert len(chosen) == len(ids) == 60 and not ids & {2000, 2001, 2002, None}
    assert sum(i < 1000 for i in ids) <= 8
    assert {r.frame_id for r in subset.varied_frames(df, 60).collect()} == ids
    assert subset.varied_frames(df, 10_000).count() == 400
    assert subset.varied_frames(df.limit(0), 5).count() == 0


def test_density_counts_copies(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)] + [(9, [9e5, 9e5]), (10, None), (11, [float("nan"), 1.0]), (12, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, f array<double>")
    got = {r.id: r.density for r in subset.local_density(df, "id", "f", 2).collect()}
    assert got == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5, 9: 1}


def test_crowded_points_share_a_partner(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        x, y = 900.0 * k + 50, 70.0
        spread = [(0, 0, x + rng.uniform(-400, 400), y + rng.uniform(0, 900), 1.0) for _ in range(8)]
        crowd = [(0, 0, x + rng.uniform(-0.4, 0.4), y + rng.uniform(-0.4, 0.4), 1.0) for _ in range(82)]
        rows.append((10 * k, 1, "train" if k % 2 else "validation", True, [*spread, *crowd]))
        # One point in the crowd and eight or more that no point of the other frame is near.
        rows.append((10 * k + 1, 1, "validation" if k % 2 else "train", True, [(0, 0, x, y, 1.0)] + [(0, 0, x + 40 * j, y - 900 + 30 * j, 1.0) for j in range(8 + k % 3)]))
    want = _brute(rows)
    assert len(want) == 12
    assert {tuple(r) for r in overlap.frame_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_sample_ends_in_a_crowded_bin(spark, monkeypatch):
    df = spark.range(3000).withColumn("w", F.lit(1.0))
    whole = {r.id for r in subset.weighted_sample(df, "id", "w", 1234).collect()}
    monkeypatch.setattr(subset, "CUT", 2)
    assert {r.id for r in subset.weighted_sample(df, "id", "w", 1234).collect()} == whole and len(whole) == 1234
