import numpy as np
from pyspark.sql import functions as F

from fieldloom.kernels.spline import robust_rigid
from fieldloom.operators import calibration as cal
from fieldloom.plans import calibration as plans


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_held_out_metrics_take_few_jobs_and_equal_a_loop(spark):
    folder, got = "/root/testdata/sf0.001", {}
    # Ten turns used to be three and more jobs each.
    assert _jobs(spark, "holdout", lambda: got.update({r.video_id: r for r in plans.holdout_metrics(spark, folder).collect()})) < 45
    observed = plans._observed(spark, folder)
    fields = plans._fields(observed)
    c = {r.video_id: r for r in fields.collect()}
    errors = {}
    for r in cal._flat(observed.where("role = 'validation'")).collect():
        v = np.array(r.v).reshape(-1, 5)
        if r.video_id not in c or len(v) < 6:
            continue
        x, y = plans.LATTICE.moved(np.array(c[r.video_id].coefficients).reshape(-1, 2), v[:, 2], v[:, 3])
        z, q = x + 1j * y, c[r.video_id].step * (v[:, 0] + 1j * v[:, 1])
        turn, shift, _ = robust_rigid(q[::2], z[::2], v[::2, 4], 1.5)
        errors.setdefault(r.video_id, []).extend(np.abs(shift + turn * q - z)[1::2])
    assert errors and {v for v, r in got.items() if r.n} == set(errors)
    for video, e in errors.items():
        assert got[video].n == len(e) and abs(got[video].rms - np.sqrt(np.mean(np.square(e)))) < 0.006
    frames = observed.where("role = 'validation'").groupBy("video_id").agg(F.count("*").alias("n")).collect()
    assert {r.video_id: r.n for r in frames} == {v: r.frames for v, r in got.items()}
