import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import pose as P
from fieldloom.functions import image, spline, stats
from fieldloom.operators import fits, graph, network, spatial, windows
from fieldloom.operators import observations as obs


def _points(spark, rows):
    return spark.createDataFrame([(v, f, True, "train", float(c), float(r), float(x), float(y), 1.0) for v, f, c, r, x, y in rows], "video_id int, frame_id int, enabled boolean, role string, col double, row double, x double, y double, w double")


def test_quantile_rules(spark):
    df = spark.createDataFrame([([],), ([1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(
        stats.upper_quantile(F.col("v"), 0.5).alias("u"), stats.nearest_quantile(F.col("v"), 0.5).alias("n"), stats.floor_quantile(F.col("v"), 0.5).alias("f"))
    assert [tuple(r) for r in df.collect()] == [(None, 0.0, None), (3.0, 3.0, 2.0)]
    assert spark.range(1).select(stats.half_up(F.lit(-2.5)).alias("h")).first().h == -2


def test_similarity_scales_and_rigid_errors(spark):
    rows = [(1, k, c, r, c * 10 * s, r * 10 * s) for k, s in ((1, 1.0), (2, 1.1)) for c in (0, 1) for r in (0, 1)]
    m = obs.video_metrics(_points(spark, rows), 10.0).first()
    assert m.rigid_p95 > 0.4 and m.similarity_p95 < 1e-9 and m.scale_p05 == pytest.approx(1) and m.scale_p95 == pytest.approx(1.1)


def test_affine_of_a_stretched_grid(spark):
    rows = [(1, 1, c, r, -2 * r, c) for c in range(3) for r in range(3)] + [(1, 2, c, r, r, c) for c in range(3) for r in range(3)] + [(1, 3, c, 0, c, 0) for c in range(5)]
    got = fits.affine_geometry(_points(spark, rows), ["frame_id"]).collect()
    assert [(r.frame_id, round(r.scale, 9), round(r.anisotropy, 9)) for r in got] == [(1, round(math.sqrt(2), 9), 2.0)]


def test_consistent_frames(spark):
    rows = [(1, k, c, r, c * s, r * s) for k, s in enumerate((1, 1.004, 0.997, 0.91, 1.08)) for c in range(3) for r in range(3)]
    got = obs.consistent_cluster(fits.affine_geometry(_points(spark, rows), ["frame_id"])).orderBy("frame_id").collect()
    assert [r.selected for r in got] == [True, True, True, False, False]


def test_stabilised_pose(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 4.0), (1, 1, 2.0, -2.0, 0.01, 10.0), (1, 2, None, None, None, None), (1, 3, 10.0, -10.0, 0.02, 10.0)]
    got = windows.stabilised(spark.createDataFrame(rows, "t int, f int, x double, y double, rotation double, points double"), "t", "f", 3).orderBy("f").collect()
    assert got[2].x is None and (got[3].x, got[3].y) == (6.0, -6.0) and got[3].rotation == pytest.approx(0.015)


def test_closure_is_spread(spark):
    path = spark.createDataFrame([(1, f, float(f), 2.0 * f, 0.0) for f in (0, 5, 10, 15)], "t int, f int, x double, y double, rotation double")
    closures = spark.createDataFrame([(1, 0, 10, -10.0, -20.0, -0.1), (1, 3, 3, 9.0, 9.0, 9.0)], "t int, anchor int, frame int, dx double, dy double, turn double")
    got = [(r.f, r.x, r.y, round(r.rotation, 12)) for r in windows.closed_loops(path, closures, "t", "f").orderBy("f").collect()]
    assert got == [(0, 0.0, 0.0, 0.0), (5, 0.0, 0.0, -0.05), (10, 0.0, 0.0, -0.1), (15, 5.0, 10.0, -0.1)]


def test_spacing(spark):
    df = spark.range(100000).select(F.lit(1).alias("t"), F.col("id").alias("f"))
    assert [r.f for r in windows.evenly_spaced(df, "t", "f", 5).orderBy("f").collect()] == [0, 25000, 50000, 74999, 99999]
    assert [r.f for r in windows.evenly_spaced(df.where("f < 9"), "t", "f", 1).collect()] == [8]
    assert [r.f for r in windows.midpoints(df.where("f < 10"), "t", "f", 3).orderBy("f").collect()] == [1, 5, 8]


def test_interpolation_between_anchors(spark):
    path = spark.createDataFrame([(1, f, float(f), 0.0, 0.0) for f in range(5)], "t int, f int, x double, y double, rotation double")
    anchors = spark.createDataFrame([(1, 1, 2.0, 0.0, 0.0), (1, 3, 3.0, 2.0, 0.0)], "t int, f int, ax double, ay double, arotation double")
    got = {r.f: (round(r.x, 9), round(r.y, 9)) for r in windows.between_anchors(path, anchors, "t", "f").collect()}
    assert got == {0: (1, 0), 1: (2, 0), 2: (2.5, 1), 3: (3, 2), 4: (4, 2)}
    moved = {r.f: (r.x, r.y) for r in windows.within_visits(path, anchors, "t", "f").collect()}
    assert moved == {0: (1, 0), 2: (2.5, 1), 4: (4, 2)}


def test_closest_time_ties_go_to_the_later(spark):
    samples = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "t int, time long, v string")
    asks = spark.createDataFrame([(1, 15, 1), (1, 14, 2), (1, 99, 3), (1, 10, 4), (2, 5, 5)], "t int, time long, ask int")
    got = {r.ask: r.v for r in windows.closest_in_time(asks, samples, "t", "time", "v").collect()}
    assert got == {1: "b", 2: "a", 3: "b", 4: "a", 5: None}


def test_merge_frames_keep_lone_ones(spark):
    rows = [(k, float(x) + 500, 250.0, 0.0, s) for k, (x, s) in enumerate(((0, 9.0), (10, 8.0), (20, 7.0), (30, None), (900, None)))]
    df = spark.createDataFrame(rows, "frame int, x double, y double, rotation double, sharpness double")
    plane = spatial.Plane(1000, 500)
    assert {r.frame for r in spatial.merge_frames(plane, df, 2, 256).collect()} >= {0, 1, 2, 4}
    assert spatial.merge_frames(plane, df.limit(0), 2).count() == 0


def test_blocks(spark):
    rows = [(k, 10.0 + d, 10.0, 0.0, s) for k, (d, s) in enumerate(((0, 2.0), (0, 9.0), (0, 5.0), (0, 4.0), (30, 4.0)))]
    df = spark.createDataFrame(rows, "frame int, x double, y double, rotation double, sharpness double")
    blocks = spatial.block_ranks(spatial.Plane(20, 20), df, 5, 2)
    assert {r.frame for r in spatial.reduced_frames(blocks).collect()} == {1, 2, 4}


def test_spline_weights_and_affine_field(spark):
    one = spark.range(1).select(F.lit(0.3).alias("t")).select(F.aggregate(spline.basis(F.col("t")), F.lit(0.0), lambda a, v: a + v).alias("s")).first().s
    assert one == pytest.approx(1, abs=1e-14)
    coefficients = spark.createDataFrame([(c, r, 0.01 * (c - 1) * 50 + 2, -0.02 * (r - 1) * 50) for c in range(8) for r in range(8)], "cx long, cy long, dx double, dy double")
    got = spline.evaluate(spark.createDataFrame([(1, 120.0, 75.5)], "k int, x double, y double"), coefficients, "k", "x", "y", 50.0).first()
    assert (got.dx, got.dy, got.xx, got.yy) == pytest.approx((3.2, -1.51, 1.01, 0.98), abs=1e-10)


def test_gain_and_stiffness(spark):
    px = spark.createDataFrame([(128, 255), (128, 0)], "v int, a int").select(image.with_gain(F.col("v"), F.lit(0.5), F.col("a")).alias("v")).collect()
    assert [r.v for r in px] == [92, 128]  # 128 is 0.2159 of full light, its half is encoded as 92.5
    w = spark.range(1).select(image.stiffness(F.lit(0.999), F.lit(1e5), F.lit(None).cast("double"), F.lit(60), F.lit(0.2), F.lit(0.1)).alias("s"), image.stiffness(F.lit(0.91), F.lit(130.0), F.lit(None).cast("double"), F.lit(3), F.lit(6.0), F.lit(2.0)).alias("w")).first()
    assert w.s > 200 and w.s > 30 * w.w


def test_components_and_adjustment(spark):
    nodes = spark.createDataFrame([(1, f, f * 11.0, 0.0, 0.0) for f in range(6)] + [(1, 9, 0.0, 0.0, 0.0)], "run long, frame long, x double, y double, rotation double")
    edges = spark.createDataFrame([(1, f, f + 1, 11.0, 0.0, 0.0, 1.0) for f in range(5)] + [(1, 0, 3, 30.0, 0.0, 0.0, 8.0), (1, 0, 5, 50.0, 0.0, 0.0, 8.0)], "run long, reference long, current long, dx double, dy double, turn double, weight double")
    label = {r.frame: r.label for r in graph.components(nodes, edges, ["run"]).collect()}
    assert label == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 9}
    got = {r.frame: r for r in graph.adjusted_poses(nodes, edges, ["run"]).collect()}
    assert abs(got[0].x) < 1e-6 and -5 < got[3].x - 33 < -1 and got[5].x - 55 < -4 and got[5].after_rms < got[5].before_rms / 3 and got[9].x == 0


def test_keyframes_of_a_serpentine(spark):
    rows = [(1, f, float(f % 100 if (f // 100) % 2 == 0 else 100 - f % 100) * 8, float(f // 100) * 40, 0.0) for f in range(201)]
    keys = [r.f for r in graph.keyframes(spark.createDataFrame(rows, "t int, f int, x double, y double, rotation double"), "t", "f", 90.0).orderBy("f").collect()]
    assert keys[0] == 0 and keys[-1] == 200 and len(keys) < 32 and any(98 <= k <= 102 for k in keys)


def test_cells_make_an_edge(spark):
    c, s = math.cos(0.2), math.sin(0.2)
    cells = [(1, 2, 5 + c * x - s * y, -3 + s * x + c * y, float(x), float(y), 0.9, None) for x, y in ((0, 0), (100, 0), (0, 80), (90, 70))] + [(1, 3, 0.0, 0.0, 0.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(cells, "reference int, current int, rx double, ry double, cx double, cy double, quality double, confidence double")
    pairs = spark.createDataFrame([(1, 2, 10.0), (1, 3, 1.0)], "reference int, current int, weight double")
    got = network.cell_edges(pairs, df, ["reference", "current"]).collect()
    assert len(got) == 1 and (got[0].x, got[0].y, got[0].rotation) == pytest.approx((5, -3, 0.2))
    tombs = spark.createDataFrame([(1, 2, 5.0, -3.0, 1.0, 1.0, 8.0)], "reference int, current int, rx double, ry double, cx double, cy double, radius double")
    assert network.suppressed_cells(df, tombs, ["reference", "current"]).count() == 4


def test_pose_round_trip(spark):
    p = P.pose(F.lit(3.0), F.lit(-2.0), F.lit(2.5))
    q = P.pose(F.lit(-1.0), F.lit(7.0), F.lit(1.5))
    r = spark.range(1).select(P.compose(q, P.relative(p, q)).alias("a"), P.exponential(P.logarithm(p)).alias("b"), P.interpolate(q, p, F.lit(1.0)).alias("c")).first()
    for got in (r.a, r.b, r.c):
        assert tuple(got) == pytest.approx((3.0, -2.0, 2.5))
