"""Diagnostics of observation frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import stats
from fieldloom.operators import fits, ranks
from fieldloom.storage import Scratch


def error_statistics(errors: DataFrame, key: list[str], error: str) -> DataFrame:
    """Count, upper median, rms and upper 95 % of the errors of each key."""
    held = Scratch(errors.sparkSession, "errors").save(errors.select(*key, F.col(error).alias("e")), "errors")
    rms = held.groupBy(*key).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"))
    at = ranks.exact_ranks(held, key, "e", {"median": ranks.upper(0.5), "p95": ranks.upper(0.95)})
    return at.join(rms, list(key)).select(*key, F.col("n").cast("int").alias("n"), "median", "rms", "p95")


def heldout_errors(frames: DataFrame, sigma: float = 1.0, delta: float = 1.5, rounds: int = 8) -> DataFrame:
    """Distance of every odd point of a frame from the rigid pose that the even points have.

    ``frames`` has ``points`` in their order and the ``step`` of the grid in pixels. The pose is fitted ``rounds`` times, points further off than
    ``sigma * delta`` weighing less. Points without a finite place do not count; frames of fewer than three
    points on a side, or without weight, have no errors.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, frame, step, p in zip(batch["video_id"], batch["frame_id"], batch["step"], batch["points"]):
                v = np.array([[q["grid_col"], q["grid_row"], q["x"], q["y"], 1.0 if q["confidence"] is None else q["confidence"]] for q in p if q is not None], float).reshape(-1, 5)
                v = v[np.isfinite(v).all(axis=1)]
                q, z, own = step * (v[:, 0] + 1j * v[:, 1]), v[:, 2] + 1j * v[:, 3], v[::2, 4]
                if len(v) < 6 or not own.sum() > 0:
                    continue
                w = own
                for _ in range(rounds):
                    mq, mz = (w * q[::2]).sum() / w.sum(), (w * z[::2]).sum() / w.sum()
                    turn = np.exp(1j * np.angle((w * np.conj(q[::2] - mq) * (z[::2] - mz)).sum()))
                    off = np.abs(mz + turn * (q - mq) - z)
                    w = own * np.minimum(1, delta * sigma / np.maximum(off[::2], 1e-20))
                out += [(video, frame, e) for e in off[1::2]]
            yield pd.DataFrame(out, columns=["video_id", "frame_id", "error"])

    return frames.select("video_id", "frame_id", "step", "points").mapInPandas(score, "video_id long, frame_id long, error double")


def frame_metrics(points: DataFrame, step: float = 1.0) -> DataFrame:
    """Rms of the rigid and of the similarity fit of every enabled frame of three or more points, and its centre."""
    usable = points.where("enabled")
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return (
        fits.residuals(usable, ["video_id", "frame_id"], step).groupBy("video_id", "frame_id")
        .agg(F.count("*").alias("n"), rms("rigid_error").alias("rigid_rms"), rms("similarity_error").alias("similarity_rms"),
             F.first("scale").alias("scale"), F.first("mx").alias("centre_x"), F.first("my").alias("centre_y")).where("n >= 3")
    )


def movements(metrics: DataFrame, step: float = 1.0) -> DataFrame:
    """The move of every frame's centre from the frame before, its octant from a move of 1 px on, and whether it is a near duplicate."""
    before = Window.partitionBy("video_id").orderBy("frame_id")
    dx, dy = F.col("centre_x") - F.lag("centre_x").over(before), F.col("centre_y") - F.lag("centre_y").over(before)
    moved = metrics.select("video_id", "frame_id", dx.alias("dx"), dy.alias("dy")).where("dx IS NOT NULL").withColumn("moved", F.expr("sqrt(dx * dx + dy * dy)"))
    octant = F.pmod(stats.half_up(F.atan2("dy", "dx") / F.expr("pi() / 4")) + 8, F.lit(8))
    return moved.select("video_id", "frame_id", "moved", F.when(F.col("moved") >= 1, octant).alias("octant"), (F.col("moved") < F.greatest(F.lit(1.0), F.lit(step * 0.1))).alias("near"))


def video_metrics(points: DataFrame, step: float = 1.0) -> DataFrame:
    """Per video: quantiles of the fits and moves, distinct octants and the share of near duplicates."""
    scratch = Scratch(points.sparkSession, "metrics")
    each = scratch.save(frame_metrics(points, step), "frames")
    moves = scratch.save(movements(each, step), "moves")
    fit = each.groupBy("video_id").agg(F.count("*").alias("frames"), F.sum("n").alias("points"))
    move = moves.groupBy("video_id").agg(F.count_distinct("octant").alias("direction_bins"), F.avg(F.col("near").cast("double")).alias("near_share"))
    named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("rigid_rms", "similarity_rms", "scale")])
    values = each.select("video_id", F.inline(named)).unionByName(moves.select("video_id", F.lit("moved").alias("metric"), F.col("moved").alias("value")))
    at = ranks.exact_ranks(values, ["video_id", "metric"], "value", {"low": ranks.nearest(0.05), "middle": ranks.nearest(0.5), "high": ranks.nearest(0.95)})
    pick = lambda metric, rank, name: F.coalesce(F.max(F.when(F.col("metric") == metric, F.col(rank))), F.lit(0.0)).alias(name)
    wide = at.groupBy("video_id").agg(
        pick("rigid_rms", "middle", "rigid_median"), pick("rigid_rms", "high", "rigid_p95"), pick("similarity_rms", "middle", "similarity_median"), pick("similarity_rms", "high", "similarity_p95"),
        pick("scale", "low", "scale_p05"), pick("scale", "high", "scale_p95"), pick("moved", "middle", "movement_median"),
    )
    return fit.join(wide, "video_id").join(move, "video_id", "left").select(
        "video_id", "frames", "points", "rigid_median", "rigid_p95", "similarity_median", "similarity_p95", "scale_p05", "scale_p95", "movement_median",
        F.coalesce("direction_bins", F.lit(0)).alias("direction_bins"), F.coalesce("near_share", F.lit(0.0)).alias("near_share"),
    )


def residual_grid(points: DataFrame, width: float, height: float, cols: int, rows: int, step: float = 1.0) -> DataFrame:
    """Per grid cell: distinct frames, points, and the sum of rigid errors."""
    cell = lambda c, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(c) / size * n))).cast("int")
    rows_ = fits.residuals(points.where("enabled"), ["video_id", "frame_id"], step)
    return rows_.groupBy(cell("x", width, cols).alias("cell_col"), cell("y", height, rows).alias("cell_row")).agg(
        F.count_distinct("frame_id").alias("frames"), F.count("*").alias("points"), F.sum("rigid_error").alias("error_sum")
    )


def consistent_cluster(geometry: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Which frames share the commonest scale and anisotropy: those near the frame with most frames near it.

    The densities come from an equi-join on a grid of the tolerance; ties go to the smallest frame.
    """
    radius = math.log1p(tolerance)
    logs = geometry.select("frame_id", F.log("scale").alias("ls"), F.log("anisotropy").alias("la"))
    placed = logs.withColumns({"gs": F.floor(F.col("ls") / radius), "ga": F.floor(F.col("la") / radius)})
    spread = geometry.sparkSession.createDataFrame([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], "i int, j int")
    near = placed.crossJoin(F.broadcast(spread)).select(F.col("ls").alias("os"), F.col("la").alias("oa"), (F.col("gs") + F.col("i")).alias("gs"), (F.col("ga") + F.col("j")).alias("ga"))
    close = (F.abs(F.col("ls") - F.col("os")) <= radius) & (F.abs(F.col("la") - F.col("oa")) <= radius)
    dense = placed.join(near, ["gs", "ga"]).where(close).groupBy("frame_id", "ls", "la").count()
    centre = dense.orderBy(F.desc("count"), "frame_id").limit(1).select(F.col("ls").alias("cs"), F.col("la").alias("ca"))
    chosen = (F.abs(F.col("ls") - F.col("cs")) <= radius) & (F.abs(F.col("la") - F.col("ca")) <= radius)
    return logs.crossJoin(F.broadcast(centre)).select("frame_id", chosen.alias("selected"))


def coverage_grid(points: DataFrame, cell: float, radius: float, columns: int, rows: int) -> DataFrame:
    """Per cell: how many training frames have a point within ``radius`` of its centre, at most 255."""
    low = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - radius) / cell - 0.5))
    high = lambda c, n: F.least(F.lit(n - 1), F.floor((F.col(c) + radius) / cell - 0.5))
    train = points.where("enabled AND role = 'train'")
    some = train.withColumns({"l": low("x"), "r": high("x", columns), "t": low("y"), "b": high("y", rows)}).where("l <= r AND t <= b")
    each = some.withColumn("cell_col", F.explode(F.sequence("l", "r"))).withColumn("cell_row", F.explode(F.sequence("t", "b")))
    dx, dy = (F.col("cell_col") + 0.5) * cell - F.col("x"), (F.col("cell_row") + 0.5) * cell - F.col("y")
    return each.where(dx * dx + dy * dy <= radius * radius).groupBy("cell_col", "cell_row").agg(F.least(F.lit(255), F.count_distinct("frame_id")).alias("frames"))


def coverage_scale(grid: DataFrame, value: str) -> DataFrame:
    """Covered cells with their place between the least and the greatest positive count."""
    span = grid.where(F.col(value) > 0).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    place = F.when(F.col("high") > F.col("low"), (F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0))
    return grid.where(F.col(value) > 0).crossJoin(F.broadcast(span)).select("cell_col", "cell_row", value, place.alias("place"))


def grid_cells(points: DataFrame) -> DataFrame:
    """The checker cells of every frame: four neighbouring grid points, convex, with area and centre.

    Points that share a grid place within a frame are joined to each of their neighbours.
    """
    p = points.select("frame_id", "col", "row", "x", "y")
    side = lambda s, dc, dr: p.select("frame_id", (F.col("col") - dc).alias("col"), (F.col("row") - dr).alias("row"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    k = ["frame_id", "col", "row"]
    cells = side(0, 0, 0).join(side(1, 1, 0), k).join(side(2, 1, 1), k).join(side(3, 0, 1), k)
    cross = lambda a, b, c: (F.col(f"x{b}") - F.col(f"x{a}")) * (F.col(f"y{c}") - F.col(f"y{b}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (F.col(f"x{c}") - F.col(f"x{b}"))
    turns = [cross(i, (i + 1) % 4, (i + 2) % 4) for i in range(4)]
    convex = F.when(turns[0] > 0, (turns[1] > 0) & (turns[2] > 0) & (turns[3] > 0)).otherwise((turns[0] < 0) & (turns[1] < 0) & (turns[2] < 0) & (turns[3] < 0))
    area = sum((F.col(f"x{i}") * F.col(f"y{(i + 1) % 4}") - F.col(f"x{(i + 1) % 4}") * F.col(f"y{i}") for i in range(1, 4)), F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))
    mean = lambda c: sum((F.col(f"{c}{i}") for i in range(1, 4)), F.col(f"{c}0")) / 4
    return cells.where(convex).select(*k, (F.abs(area) / 2).alias("area"), mean("x").alias("x"), mean("y").alias("y"))


def area_summary(cells: DataFrame) -> DataFrame:
    """Per frame: count, least, greatest, mean, median and deviation of the cell areas, and the greatest relative one."""
    return cells.groupBy("frame_id").agg(
        F.count("*").alias("n"), F.min("area").alias("low"), F.max("area").alias("high"), F.avg("area").alias("mean"), F.median("area").alias("middle"),
        F.stddev_pop("area").alias("deviation"),
    ).withColumn("worst", F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")) / F.col("mean"))


def violations(frames: DataFrame, least_points: int = 6) -> DataFrame:
    """The rules that a frame breaks: role, empty list, grid place used twice, confidence out of range."""
    conf, places = F.col("points.confidence"), F.transform("points", lambda p: F.struct(p["grid_col"], p["grid_row"]))
    rules = {
        "role": F.coalesce(~F.col("role").isin("train", "validation"), F.lit(True)),
        "few points": F.coalesce(F.size("points") < least_points, F.lit(True)),
        "place twice": F.size(F.array_distinct(places)) < F.size(places),
        "confidence": F.exists(conf, lambda c: (c <= 0) | (c > 1)),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())
    return frames.select("frame_id", F.explode(broken).alias("rule"))


def enough_frames(frames: DataFrame, key: str, least: int) -> DataFrame:
    """The frames of those keys that have ``least`` of them."""
    held = frames.groupBy(key).agg(F.count("*").alias("held")).where(F.col("held") >= least)
    return frames.join(held.select(key), key, "left_semi")


def reference_order(frames: DataFrame, preferred: DataFrame) -> DataFrame:
    """The order in which train frames are tried as reference: the ``preferred`` one of their video, then by number of points."""
    first = F.col("frame_id").eqNullSafe(F.col("preferred"))
    order = Window.partitionBy("video_id").orderBy(first.desc(), F.size("points").desc(), "frame_id")
    return frames.join(preferred.select("video_id", "preferred"), "video_id", "left").select("video_id", "frame_id", F.row_number().over(order).alias("place"))


def white_parity(cells: DataFrame, key: list[str], value: str, contrast: float = 1.35) -> DataFrame:
    """Which parity of ``row + col`` is the white one, by the middle brightness of both; null without enough contrast."""
    parity = (F.col("row") + F.col("col")) % 2
    m = cells.groupBy(*key).agg(*[F.median(F.when(parity == p, F.col(value))).alias(n) for p, n in ((0, "a"), (1, "b"))])
    clear = F.greatest("a", "b") >= F.least("a", "b") * contrast
    return m.select(*key, F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & clear, (F.col("b") > F.col("a")).cast("int")).alias("parity"))


def block_luminance(pixels: DataFrame, key: list[str], deviation: float = 0.035, span: float = 0.16) -> DataFrame:
    """The mean light (``v``) of the blocks that are even and neither dark nor saturated (``g`` below 253)."""
    m = pixels.groupBy(*key).agg(F.max("g").alias("top"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("luminance"), F.stddev_pop("v").alias("sd"))
    even = (F.col("sd") / F.col("luminance") <= deviation) & ((F.col("high") - F.col("low")) / F.col("luminance") <= span)
    return m.where((F.col("top") < 253) & (F.col("low") > 0.01) & even).select(*key, "luminance")
