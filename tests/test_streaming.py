import pytest
from pyspark.sql import functions as F

from fieldloom.operators import steps, windows
from fieldloom.streaming import paths

SCHEMA = "track bigint, frame bigint, x double, y double, rotation double, points double, success boolean, t timestamp"


def _rows():
    out = []
    for track in (1, 2):
        for i in range(30):
            frame = i * 3 + (300 if i > 14 else 0)
            pose = (None, None, None) if i == 7 else (i * 1.5 + track, -i * 0.5, 0.02 * i)
            out.append((track, frame, *pose, float(1 + i % 4), i % 5 != 0, None))
    return out


def _run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def _stream(spark, tmp_path, rows, parts=3):
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_visits_equal_the_batch(spark, tmp_path):
    rows = sorted(_rows(), key=lambda r: r[1])
    got = _run(spark, paths.stream_visits(_stream(spark, tmp_path, rows), "track", "frame"), "visits")
    want = windows.visits(spark.createDataFrame(rows, SCHEMA), "track", "frame").select("track", "frame", "visit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stabilised_equals_the_batch_and_drops_what_is_late(spark, tmp_path):
    rows = sorted(_rows(), key=lambda r: r[1])
    again = [rows[5], rows[5]]
    got = {(r.track, r.frame): r for r in _run(spark, paths.stream_stabilised(_stream(spark, tmp_path, rows + again), "track", "frame", 5), "smooth").collect()}
    want = windows.stabilised(spark.createDataFrame(rows, SCHEMA), "track", "frame", 5).collect()
    assert len(got) == len(want) == 60
    for w in want:
        g = got[w.track, w.frame]
        assert (g.x is None) == (w.x is None) and (w.x is None or (g.x, g.y, g.rotation) == pytest.approx((w.x, w.y, w.rotation)))


def test_failure_rates(spark, tmp_path):
    rows = spark.createDataFrame(_rows(), SCHEMA).withColumn("t", F.timestamp_seconds(F.col("frame")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = _run(spark, paths.failure_rates(stream, "t", "track"), "failures", "complete")
    assert got.agg(F.sum("attempts"), F.sum("failures")).first() == (60, 12)


def test_context_runs_equal_the_batch(spark, tmp_path):
    rows = sorted(_rows(), key=lambda r: r[1])
    low = F.when(F.col("frame") % 21 == 0, 0.5).otherwise(0.9)
    got = _run(spark, paths.stream_context(_stream(spark, tmp_path, rows).withColumn("s", low), "track", "frame", "s"), "context")
    want = steps.context_frames(spark.createDataFrame(rows, SCHEMA).withColumn("s", low), "track", "frame", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_closures_correct_a_stream(spark, tmp_path):
    rows = sorted(_rows(), key=lambda r: r[1])
    log = spark.createDataFrame([(1, 6, 30, -3.0, 1.0, 0.1), (1, 9, 9, 5.0, 5.0, 5.0), (1, 12, 50, 1.0, 0.0, 0.0)], "track bigint, anchor bigint, frame bigint, dx double, dy double, turn double")
    got = {(r.track, r.frame): r for r in _run(spark, paths.corrected_view(_stream(spark, tmp_path, rows), log, "track", "frame"), "corrected").collect()}
    want = windows.closed_loops(spark.createDataFrame(rows, SCHEMA), log, "track", "frame").collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w.track, w.frame]
        assert (g.x, g.y, g.rotation) == pytest.approx((w.x, w.y, w.rotation))
