import math

from pyspark.sql import functions as F

from fieldloom.operators.observations import heldout_errors
from fieldloom.plans.planning import heldout_verdict

POINTS = "array<struct<grid_col: int, grid_row: int, x: double, y: double, confidence: double>>"


def _board(turn, shift=0.0, n=5):
    """A turned board of step 40 of which the odd points lie ``shift`` off."""
    c, s = math.cos(turn), math.sin(turn)
    at = [(k % n, k // n) for k in range(n * n)]
    return [(i, j, 100 + 40 * (c * i - s * j) + (shift if k % 2 else 0.0), 50 + 40 * (s * i + c * j), None) for k, (i, j) in enumerate(at)]


def test_odd_points_are_scored_by_the_pose_of_the_even_ones(spark):
    far = _board(0.1)
    far[0] = (0, 0, 900.0, 900.0, 1.0)  # a stray that the rounds weigh down
    rows = [(1, 1, _board(0.3)), (1, 2, _board(-2.0, 3.0)), (1, 3, _board(0.2)[:5]), (1, 4, far)]
    e = heldout_errors(spark.createDataFrame(rows, f"video_id long, frame_id long, points {POINTS}").withColumn("step", F.lit(40.0)))
    got = {r.frame_id: (r.n, r.low, r.high) for r in e.groupBy("frame_id").agg(F.count("*").alias("n"), F.min("error").alias("low"), F.max("error").alias("high")).collect()}
    assert set(got) == {1, 2, 4} and got[1][0] == 12
    assert got[1][2] < 1e-9 and abs(got[2][1] - 3) < 1e-9 and abs(got[2][2] - 3) < 1e-9 and got[4][2] < 2


def test_verdict_depends_on_the_fit_and_not_on_the_number_of_frames(spark, tmp_path):
    rows = [(k, 1, "Validation ", _board(0.01 * k)) for k in range(60)] + [(100 + k, 2, "validation", _board(0.3, 3.0)) for k in range(3)]
    rows += [(200 + v, v, "train", _board(0.5)) for v in (1, 2)]
    f = spark.createDataFrame(rows, f"frame_id long, video_id long, role string, points {POINTS}")
    f.select("*", F.lit(1).cast("long").alias("timestamp_us"), F.lit(True).alias("enabled"), F.lit("").alias("reason")).write.parquet(f"{tmp_path}/frames.parquet")
    assert {r.video_id: r.quality for r in heldout_verdict(spark, str(tmp_path)).collect()} == {1: "validated", 2: "provisional"}
