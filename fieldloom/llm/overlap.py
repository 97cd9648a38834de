"""Frames of an evaluation split that also occur, exactly or almost, in the training split.

Two frames match when, of the one with more points, at least nine tenths have a point of the other
within a radius. Each frame is canonicalised to hashes that any match must share: its points are
ordered along a fixed direction, whatever their order and numbering, and the first and the last of
them are anchors. With ``n`` points at most ``n // 10`` have no partner, so the first partnered point
is among the first ``n // 10 + 1``; a partner's projection differs by the radius at most, which the
margin of the anchors allows for. A hash is that of the grid cells of a first and a last anchor;
training frames give the cells of their anchors, evaluation frames all cells within the radius of
theirs. The join of the hashes thus finds every match. Across the direction, the places of the first
and of the last partnered point differ by the radius at most as well; the ranges in which they lie
travel with the hash and thin the candidates. The exact rule is then checked. Where points of a frame lie so near each
other that they may share a partner, the frame with fewer points may have more than a tenth without one; such
frames are looked up by their first anchors alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Direction of the order, chosen so that points of a level grid seldom tie.
ANGLE = 0.7131
#: Edge of the grid cells in pixels.
CELL = 8.0


def usable_points(points: str = "points", limit: float = 1e9) -> str:
    """SQL of the points with finite x and y, as structs of both; null for a null list."""
    ok = f"p.x IS NOT NULL AND p.y IS NOT NULL AND NOT isnan(p.x) AND NOT isnan(p.y) AND abs(p.x) < {limit}D AND abs(p.y) < {limit}D"
    return f"transform(filter({points}, p -> {ok}), p -> named_struct('x', CAST(p.x AS DOUBLE), 'y', CAST(p.y AS DOUBLE)))"


def _anchors(df: DataFrame, radius: float) -> DataFrame:
    c, s, margin = math.cos(ANGLE), math.sin(ANGLE), 2 * radius + 1e-6
    return (
        df.withColumn("n", F.expr("size(pts)"))
        .withColumn("line", F.expr(f"array_sort(transform(pts, p -> named_struct('t', p.x * {c!r}D + p.y * {s!r}D, 'x', p.x, 'y', p.y)))"))
        .withColumn("head", F.expr(f"filter(line, q -> q.t <= line[n div 10].t + {margin!r}D)"))
        .withColumn("tail", F.expr(f"filter(line, q -> q.t >= line[n - 1 - n div 10].t - {margin!r}D)"))
        .withColumn("across", F.expr(f"array_sort(transform(pts, p -> p.y * {c!r}D - p.x * {s!r}D))"))
        .withColumn("ranges", F.expr(_packed("across[0]", "across[n div 10]", "across[n - 1 - n div 10]", "across[n - 1]", radius=radius)))
        .drop("line", "across", "pts", "n")
    )


def _packed(*ends: str, radius: float) -> str:
    """Two ranges in whole pixels, rounded outwards by the radius, as the four parts of one bigint."""
    grown = [f"floor({e} - {radius / 2!r}D)" if i % 2 == 0 else f"ceil({e} + {radius / 2!r}D)" for i, e in enumerate(ends)]
    parts = [f"shiftleft(CAST(least(65535D, greatest(0D, {g} + 32768D)) AS BIGINT), {16 * i})" for i, g in enumerate(grown)]
    return " | ".join(parts)


def _meet(a: str, b: str) -> str:
    """Whether both ranges of ``a`` and ``b`` meet."""
    part = lambda x, i: f"(shiftrightunsigned({x}, {16 * i}) & 65535)"
    return " AND ".join(f"{part(a, i)} <= {part(b, i + 1)} AND {part(b, i)} <= {part(a, i + 1)}" for i in (0, 2))


def _cell(x: str, y: str) -> str:
    return f"floor(({x}) / {CELL!r}D) * 4294967296L + floor(({y}) / {CELL!r}D)"


def _hashes(df: DataFrame, reach: float | None) -> DataFrame:
    """One row for each hash of a frame; with ``reach``, for all cells within it."""
    def cells(side: str) -> str:
        if reach is None:
            return f"transform({side}, q -> {_cell('q.x', 'q.y')})"
        near = ", ".join(_cell(f"q.x {a} {reach!r}D", f"q.y {b} {reach!r}D") for a in "+-" for b in "+-")
        return f"flatten(transform({side}, q -> array_distinct(array({near}))))"

    pairs = "flatten(transform(heads, h -> transform(tails, t -> xxhash64(h, t))))"
    return (
        df.withColumn("heads", F.expr(f"array_distinct({cells('head')})"))
        .withColumn("tails", F.expr(f"array_distinct({cells('tail')})"))
        .select("id", "ranges", F.explode(F.expr(f"array_distinct({pairs})")).alias("hash"))
    )


def _crowded(radius: float) -> str:
    """SQL of whether two points of a frame may lie within twice the radius: then they share a cell of one of four grids."""
    edge = 4 * radius + 1e-6
    grids = [f"size(array_distinct(transform(pts, p -> {_cell(f'p.x / {edge!r}D * {CELL!r}D + {a}D', f'p.y / {edge!r}D * {CELL!r}D + {b}D')}))) < size(pts)" for a in (0.0, CELL / 2) for b in (0.0, CELL / 2)]
    return " OR ".join(grids)


def _crowded_candidates(named: DataFrame, radius: float, train: str) -> DataFrame | None:
    """The pairs whose frame with more points has some that lie so near each other that they may share a partner.

    Of that frame a tenth at most has no partner, so one of its first anchors has one, which may be any point of the
    other frame. None if there is no such frame.
    """
    marked = named.where(F.expr(_crowded(radius)))
    if marked.isEmpty():
        return None
    near = ", ".join(_cell(f"q.x {a} {radius!r}D", f"q.y {b} {radius!r}D") for a in "+-" for b in "+-")
    heads = _anchors(marked, radius).select("id", "split", F.explode(F.expr(f"array_distinct(flatten(transform(head, q -> array({near}))))")).alias("hash"))
    places = named.select("id", "split", F.explode(F.expr(f"array_distinct(transform(pts, q -> {_cell('q.x', 'q.y')}))")).alias("hash"))
    met = heads.withColumnsRenamed({"id": "m", "split": "ms"}).join(places, "hash").where((F.col("ms") == train) != (F.col("split") == train))
    ours = F.col("ms") == train
    return met.select(F.when(ours, F.col("m")).otherwise(F.col("id")).alias("a"), F.when(ours, F.col("id")).otherwise(F.col("m")).alias("b")).where("a != b").distinct()


def split_overlaps(
    frames: DataFrame,
    frame: str = "frame_id",
    split: str = "role",
    points: str = "points",
    train: str = "train",
    evaluation: Sequence[str] = ("validation",),
    radius: float = 1.5,
    least_points: int = 9,
) -> DataFrame:
    """All pairs (``train_frame, eval_frame, split``) of matching frames, each once.

    Split names compare without regard to case and outer blanks; rows of other or null splits, of a
    null frame, and frames with fewer than ``least_points`` usable points take no part. A usable point
    has a finite position below 1e9; confidence and numbering do not matter. Copies of a row count
    once. Of two frames with equally many points either may be covered by the other. A frame in both
    splits is not paired with itself. Frames with points within twice ``radius`` of each other, of which several may
    share a partner, get candidates of their own from all points of the other frames. Further columns are ignored.

    The candidates come from an equi-join on hashes, which the engine may split where a view is very
    frequent; points are fetched for candidates only. Nothing is broadcast by hand.
    """
    named = frames.select(
        F.col(frame).alias("id"), F.lower(F.trim(F.col(split))).alias("split"), F.expr(usable_points(f"`{points}`")).alias("pts")
    ).where(F.col("id").isNotNull() & F.col("split").isin(train, *evaluation) & (F.size("pts") >= least_points))
    ours = _hashes(_anchors(named.where(F.col("split") == train).drop("split"), radius), None)
    theirs = _hashes(_anchors(named.where(F.col("split") != train), radius), radius)
    candidates = (
        ours.withColumnsRenamed({"id": "a", "ranges": "ra"})
        .join(theirs.withColumnsRenamed({"id": "b", "ranges": "rb"}), "hash")
        .where(f"a != b AND {_meet('ra', 'rb')}")
        .select("a", "b")
        .distinct()
    )
    if (more := _crowded_candidates(named, radius, train)) is not None:
        candidates = candidates.unionByName(more).distinct()
    once = named.dropDuplicates(["id", "split"])
    left = once.where(F.col("split") == train).select(F.col("id").alias("a"), F.col("pts").alias("pa"))
    right = once.where(F.col("split") != train).select(F.col("id").alias("b"), F.col("pts").alias("pb"), "split")
    both = candidates.join(left, "a").join(right, "b")
    kind = named.schema["id"].dataType.simpleString()
    return both.select("a", "b", "split", *_ordinates("pa"), *_ordinates("pb")).mapInArrow(
        _checker(radius), f"train_frame {kind}, eval_frame {kind}, split string"
    )


def _ordinates(points: str) -> list:
    return [F.col(points)["x"].alias(f"{points}_x"), F.col(points)["y"].alias(f"{points}_y")]


def _checker(radius: float):
    """Keeps the pairs of which, of the frame with more points, nine tenths have a point of the other near."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(i).offsets.to_numpy() for i in (3, 5)]
            flat = [batch.column(i).values.to_numpy() for i in (3, 4, 5, 6)]
            keep = np.zeros(batch.num_rows, bool)
            for row in range(batch.num_rows):
                a, b = slice(*ends[0][row : row + 2]), slice(*ends[1][row : row + 2])
                dx, dy = flat[0][a, None] - flat[2][None, b], flat[1][a, None] - flat[3][None, b]
                near = dx * dx + dy * dy <= radius * radius
                n, m = near.shape
                of_a, of_b = np.count_nonzero(near.any(axis=1)), np.count_nonzero(near.any(axis=0))
                keep[row] = n >= m and 10 * of_a >= 9 * n or m >= n and 10 * of_b >= 9 * m
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:3], names=["train_frame", "eval_frame", "split"])

    return check


def frame_pairs(frames: DataFrame) -> DataFrame:
    """The matching train and validation frames, smaller id first."""
    found = split_overlaps(frames)
    return found.select(
        F.least("train_frame", "eval_frame").alias("frame_id_a"), F.greatest("train_frame", "eval_frame").alias("frame_id_b")
    ).distinct()


def overlap_report(frames: DataFrame) -> DataFrame:
    """For every split and video: its frames with a match in the other split, and its share of the pairs."""
    found = split_overlaps(frames)
    both = found.select(F.lit("train").alias("role"), F.col("train_frame").alias("frame_id")).unionAll(
        found.select("split", "eval_frame")
    )
    counts = both.groupBy("role", "frame_id").agg(F.count("*").alias("pairs"))
    home = frames.select(F.lower(F.trim("role")).alias("role"), "frame_id", "video_id").dropDuplicates(["role", "frame_id"])
    return (
        counts.join(home, ["role", "frame_id"])
        .groupBy("role", "video_id")
        .agg(F.count("*").alias("frames"), F.sum("pairs").alias("pairs"))
    )
