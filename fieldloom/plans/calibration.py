"""Queries on the calibration of displacement fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldloom.adapters import OBSERVATIONS, observations, opened, points, rounded, sql_rounded, table
from fieldloom.functions import spline
from fieldloom.kernels.spline import Lattice
from fieldloom.operators import calibration as ops
from fieldloom.operators import fits, planning
from fieldloom.operators.observations import error_statistics
from fieldloom.plans.registry import query
from fieldloom.storage import Scratch

#: The pictures of all videos have one size.
LATTICE = Lattice(2160, 1440, 240.0)


def _observed(spark, folder):
    """The frames that count, without copies; written once, as they are read several times."""
    frames = observations(spark, folder).where("enabled AND role IN ('train', 'validation') AND points IS NOT NULL")
    return Scratch(spark, "observed").save(frames.select("video_id", "frame_id", "role", "enabled", "points"), "frames")


def _fields(observed):
    # The step of a video's grid is the middle scale of its train frames.
    train = observed.where("role = 'train'")
    scales = fits.rigid_fit(opened(train), ["video_id", "frame_id"]).where("n >= 3")
    steps = scales.groupBy("video_id").agg(F.median("scale").alias("step"))
    return ops.fitted_fields(train.select("video_id", "frame_id", "points"), steps, LATTICE)


@query("calibration_fit")
def calibration_fit(spark, folder):
    return rounded(_fields(_observed(spark, folder)).select("video_id", "reference", "n", "rms"), 2)


@query("fold_check")
def fold_check(spark, folder):
    return rounded(ops.fold_checks(_fields(_observed(spark, folder)), LATTICE), 2)


@query("holdout_metrics")
def holdout_metrics(spark, folder):
    observed = _observed(spark, folder)
    frames = observed.where("role = 'validation'").select("video_id", "frame_id", "points")
    errors = Scratch(spark, "holdout").save(ops.field_errors(frames, _fields(observed), LATTICE, heldout=True), "errors")
    scored = errors.groupBy("video_id").agg(F.count_distinct("frame_id").alias("scored"))
    g = frames.groupBy("video_id").agg(F.count("*").alias("frames")).join(scored, "video_id", "left").join(error_statistics(errors, ["video_id"], "error"), "video_id", "left")
    share = F.coalesce("scored", F.lit(0)) / F.col("frames")
    verdict = planning.quality(F.col("n"), F.col("frames"), share, F.col("p95"))
    return rounded(g.select("video_id", "frames", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "rms", "p95", verdict.alias("quality")), 2)


AFFINE = ("1 + (video_id % 5)*0.01::DOUBLE", "(video_id % 3)*0.02::DOUBLE", "-(video_id % 4)*0.01::DOUBLE", "1 - (video_id % 7)*0.01::DOUBLE", "(video_id % 11)::DOUBLE", "-(video_id % 13)::DOUBLE")


@query("spline_start", f"""WITH v AS (SELECT video_id, width, height, {', '.join(f'{e} AS a{i}' for i, e in enumerate(AFFINE))} FROM videos),
    g AS (SELECT v.*, c AS col, r AS row FROM v, unnest(range((width-1)//300 + 4)) a(c), unnest(range((height-1)//300 + 4)) b(r))
    SELECT video_id, col, row, {sql_rounded('(a0-1)*(col-1)*300 + a1*(row-1)*300 + a4')} AS dx, {sql_rounded('a2*(col-1)*300 + (a3-1)*(row-1)*300 + a5')} AS dy FROM g""")
def spline_start(spark, folder):
    rows = table(spark, folder, "videos").select("video_id", "width", "height", *[F.expr(e.replace("::DOUBLE", "D")).alias(f"a{i}") for i, e in enumerate(x.replace("(video_id % 11)::DOUBLE", "CAST(video_id % 11 AS DOUBLE)").replace("(video_id % 13)::DOUBLE", "CAST(video_id % 13 AS DOUBLE)") for x in AFFINE)])
    return rounded(spline.affine_start(rows, F.col("width"), F.col("height"), 300, [F.col(f"a{i}") for i in range(6)]).select("video_id", "col", "row", "dx", "dy"), shift=0.123)


@query("spline_inverse", f"WITH {OBSERVATIONS} SELECT frame_id, pos::INT AS pos, round(x + 0.00123::DOUBLE, 2) + 0.0 AS x, round(y + 0.00123::DOUBLE, 2) + 0.0 AS y FROM pts WHERE x BETWEEN 0 AND 2159 AND y BETWEEN 0 AND 1439")
def spline_inverse(spark, folder):
    """Places moved by a field and brought back."""
    bend = np.stack([6 * np.sin(np.arange(LATTICE.size)), 4 * np.cos(2 * np.arange(LATTICE.size))], axis=1)

    @F.pandas_udf("x double, y double")
    def there_and_back(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        u, v = LATTICE.moved(bend, x.to_numpy(), y.to_numpy())
        return pd.DataFrame(LATTICE.inverse(bend, u, v), columns=["x", "y"])

    inside = points(spark, folder).where("x BETWEEN 0 AND 2159 AND y BETWEEN 0 AND 1439")
    return rounded(inside.select("frame_id", "pos", there_and_back("x", "y").alias("p")).select("frame_id", "pos", "p.x", "p.y"), 2, shift=0.123)
