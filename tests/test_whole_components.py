import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph
from fieldloom.plans.network import pose_graph_optimize


def test_a_long_video_is_adjusted_as_one_component(spark, tmp_path):
    rows = [(1, f, f, 1000 * f, 1.0, True, (f - 1 if f else None, True, 25.0 * f)) for f in range(200)]
    rows[150] = (1, 150, 150, 150000, 1.0, True, (10, True, 25.0 * 150))  # comes back to a place far before
    schema = "video_id long, frame long, entry_no long, timestamp_us long, sharpness double, success boolean, m struct<frame: long, accepted: boolean, x: double>"
    m = F.struct("m.frame", "m.accepted", F.lit(None).cast("string").alias("reason"), F.struct("m.x", F.lit(0.0).alias("y"), F.lit(0.0).alias("rotation")).alias("pose"), F.lit(1.0).alias("score"))
    spark.createDataFrame(rows, schema).withColumn("incremental_match", m).drop("m").write.parquet(f"{tmp_path}/path_entries.parquet")
    got = sorted(pose_graph_optimize(spark, str(tmp_path)).collect(), key=lambda r: r.frame)
    assert len(got) == 200 and {r.label for r in got} == {0}
    moved = [r.x - 25.0 * r.frame for r in got]
    assert moved[0] == 0 and abs(moved[64]) > 0.5 and abs(moved[128]) > 0.5  # runs of 64 began anew at these
    assert abs(moved[199] - moved[150]) > 2  # and the course after the return goes on from there
    free = 2 / 10 * (0.5 * 2) * 140  # what the steps from 10 to 150 sum to without the match between these frames
    assert abs(moved[150] - moved[10]) < free / 2
    assert np.max(np.abs(np.diff(moved))) < 1 and all(r.after_rms <= r.before_rms for r in got)


@pytest.mark.parametrize("links, core", [(30, 1500), (900, 20)])
def test_sparse_solution_is_the_dense_one(links, core):
    rng, n = np.random.default_rng(1), 600
    a, b = np.r_[np.arange(n - 1), np.arange(n - 2), rng.integers(0, n // 2, links)], np.r_[np.arange(1, n), np.arange(2, n), rng.integers(n // 2, n, links)]
    ja = np.eye(3) + 0.1 * rng.normal(size=(len(a), 3, 3))
    sides = [(a, ja), (b, np.broadcast_to(-np.eye(3), ja.shape))]
    row, col, blocks = [np.array([0])], [np.array([0])], [np.eye(3)[None]]
    for p, jp in sides:
        for q, jq in sides:
            row.append(p), col.append(q), blocks.append(np.einsum("eki,ekj->eij", jp, jq))
    row, col, blocks, right = np.concatenate(row), np.concatenate(col), np.concatenate(blocks), rng.normal(size=(n, 3))
    full = np.zeros((n, n, 3, 3))
    np.add.at(full, (row, col), blocks)
    want = np.linalg.solve(full.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n), right.ravel()).reshape(n, 3)
    got = graph.solved(n, row, col, blocks, right, 64, core)
    assert np.abs(got - want).max() < 1e-8 * np.abs(want).max()
