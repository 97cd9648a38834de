"""Calibration of a displacement field per video from frames of a grid.

Poses and field are fitted in turns. A turn fits each frame's pose under the present field and adds its points to the
normal equations of its video; the solve is one small dense system for each video. A video of few points is moved once and takes all its
turns in one task. One of many is cut into chunks of frames, whose equations are summed by position with map-side aggregation;
so what meets in one place is a matrix of the number of control points, never the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.kernels.spline import Lattice, robust_rigids
from fieldloom.storage import Scratch

#: Videos whose sums a task holds at a time.
HELD = 64
#: Points of a video that takes all its turns in one task; also those of a chunk of a larger one.
WHOLE = 250_000
#: Points of small videos that are fitted together.
TOGETHER = 8_000
_FIELD = "video_id long, reference long, step double, coefficients array<double>"


def _flat(frames: DataFrame) -> DataFrame:
    """Frames with the points of known place as one array: column, row, x, y and confidence of each, a null confidence counting as 1."""
    known = "filter(points, p -> p.x IS NOT NULL AND p.y IS NOT NULL AND p.grid_col IS NOT NULL AND p.grid_row IS NOT NULL AND NOT isnan(p.x) AND NOT isnan(p.y) AND abs(p.x) < 1e9 AND abs(p.y) < 1e9 AND coalesce(p.confidence > 0, true))"
    values = f"flatten(transform({known}, p -> array(CAST(p.grid_col AS DOUBLE), CAST(p.grid_row AS DOUBLE), CAST(p.x AS DOUBLE), CAST(p.y AS DOUBLE), coalesce(CAST(p.confidence AS DOUBLE), 1D))))"
    return frames.select("video_id", "frame_id", F.expr(values).alias("v")).where("size(v) > 0")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The items of a list column as arrays, without a copy of the values."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[ends[i] : ends[i + 1]] for i in range(len(column))]


def _affine(v: np.ndarray, step: float, tau: float) -> list[float] | None:
    """The affine map (xx, xy, yx, yy, x, y) of a frame from picture to grid, none below six points or if its determinant is not above ``tau``."""
    if len(v) < 6:
        return None
    a, *_ = np.linalg.lstsq(np.c_[v[:, 2:4], np.ones(len(v))], step * v[:, :2], rcond=None)
    det = a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
    return [a[0, 0], a[1, 0], a[0, 1], a[1, 1], a[2, 0], a[2, 1]] if det > tau else None


def start_fields(frames: DataFrame, steps: DataFrame, lattice: Lattice, tau: float = 0.05) -> DataFrame:
    """(``video_id, reference, step, coefficients``): of each video the affine field of the frame with most points whose determinant is above ``tau``.

    ``frames`` has ``video_id``, ``frame_id`` and ``points``; ``steps`` the grid step of each video in pixels. Frames of fewer than six points give no start.
    """
    return _starts(_flat(frames).join(steps, "video_id"), lattice, tau)


def _starts(rows: DataFrame, lattice: Lattice, tau: float) -> DataFrame:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for video, frame, step, v in zip(*(batch.column(c).to_pylist() for c in ("video_id", "frame_id", "step")), _lists(batch.column("v")), strict=True):
                v = v.reshape(-1, 5)
                affine = _affine(v, step, tau)
                if affine:
                    out.append((video, frame, step, len(v), affine))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["video_id", "frame_id", "step", "n", "affine"])

    fitted = rows.select("video_id", "frame_id", "step", "v").mapInArrow(fit, "video_id long, frame_id long, step double, n long, affine array<double>")
    best = fitted.groupBy("video_id").agg(F.min_by(F.struct("frame_id", "step", "affine"), F.struct((-F.col("n")).alias("n"), "frame_id")).alias("b"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [lattice.start(np.array(a)).ravel().tolist() for a in batch.column("affine").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fields, pa.list_(pa.float64()))], names=["video_id", "reference", "step", "coefficients"])

    return best.select("video_id", F.col("b.frame_id").alias("reference"), "b.step", "b.affine").mapInArrow(spread, _FIELD)


class _Block:
    """Frames of three points or more of some videos, with all that stays the same from turn to turn.

    ``v`` has the points of all frames one after the other; ``lengths``, ``step``, ``slot`` (the number of the video among ``slots``)
    and ``fixed`` (whether it is the reference) are by frame.
    """

    def __init__(self, lattice: Lattice, v: np.ndarray, lengths: np.ndarray, step: np.ndarray, slot: np.ndarray, fixed: np.ndarray, slots: int):
        k = self.k = lattice.size
        self.slots, self.fixed, self.own = slots, fixed, v[:, 4]
        self.starts, self.frame = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
        self.slot = slot[self.frame]
        self.xy, self.q = v[:, 2] + 1j * v[:, 3], step[self.frame] * (v[:, 0] + 1j * v[:, 1])
        at, self.w = lattice.design(v[:, 2], v[:, 3])
        self.at = at + self.slot[:, None] * k
        # Points of one cell have the same 16 control points, so their products are summed before they are placed: in groups of up to ``wide`` points.
        self.order = np.argsort(self.at[:, 0], kind="stable")
        first = self.at[self.order, 0]
        cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        wide = int(min(64, max(8, len(v) // len(cuts))))
        place = np.arange(len(v)) - np.repeat(cuts, np.diff(np.append(cuts, len(v))))
        heads = np.flatnonzero(place % wide == 0)
        self.group, self.place = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(v)))), place % wide
        px, py = lattice.products(v[self.order, 2], v[self.order, 3])
        self.px, self.py, self.weights = (np.zeros((len(heads), *shape)) for shape in ((wide, 10), (10, wide), (16, wide)))
        self.px[self.group, self.place], self.py[self.group, :, self.place], self.weights[self.group, :, self.place] = px, py, self.w[self.order]
        one, other, self.source = lattice.pairs()
        first = first[heads][:, None]
        self.into, self.down = ((first + one) * k + first % k + other).ravel(), self.at[self.order][heads].ravel()

    def sums(self, c: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each video under its field: the normal equations, their right sides, and the squared error and count."""
        z = self.xy + np.einsum("nk,nk->n", self.w, (c[..., 0] + 1j * c[..., 1]).ravel()[self.at])
        turn, shift = robust_rigids(self.q, z, self.own, self.starts, limit)
        turn[self.fixed], shift[self.fixed] = 1, 0
        goal = shift[self.frame] + turn[self.frame] * self.q
        off = np.abs(goal - z)
        weight = (self.own * np.minimum(1, limit / np.maximum(off, 1e-20)))[self.order]
        want = (goal - self.xy)[self.order] * weight
        by = np.zeros((3, *self.px.shape[:2]))
        by[:, self.group, self.place] = weight, want.real, want.imag
        a = np.matmul(self.py * by[0][:, None, :], self.px).reshape(-1, 100)[:, self.source]
        b = [np.bincount(self.down, side.ravel(), self.slots * self.k) for side in np.moveaxis(np.matmul(self.weights, np.moveaxis(by[1:], 0, -1)), -1, 0)]
        e = [np.bincount(self.slot, off * off, self.slots), np.bincount(self.slot, minlength=self.slots)]
        return np.bincount(self.into, a.ravel(), self.slots * self.k**2).reshape(-1, self.k, self.k), np.stack(b, axis=-1).reshape(-1, self.k, 2), np.stack(e, axis=-1)


def _whole_fits(rows: DataFrame, lattice: Lattice, smooth: float, limit: float, rounds: int, tau: float) -> DataFrame:
    """(``video_id, reference, step, coefficients, n, rms``) after ``rounds`` turns of each video, and ``trace``, the rms of each; a video is fitted in one task."""
    k = lattice.size
    bending = smooth * lattice.bending() + 1e-9 * np.eye(k)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []

        def start(video: int, step: float, frames: list[tuple[int, np.ndarray]]) -> None:
            for frame, v in sorted(frames, key=lambda f: (-len(f[1]), f[0])):
                affine = _affine(v, step, tau)
                if affine:
                    ready.append((video, frame, step, lattice.start(np.array(affine)), [f for f in frames if len(f[1]) >= 3]))
                    return
                if len(v) < 6:
                    return

        def flush() -> pa.RecordBatch:
            sizes = [len(f) for *_, f in ready]
            lengths = np.array([len(v) for *_, f in ready for _, v in f])
            fixed = np.array([frame == reference for _, reference, *_, f in ready for frame, _ in f])
            slot, step = np.repeat(np.arange(len(ready)), sizes), np.repeat([r[2] for r in ready], sizes)
            block = _Block(lattice, np.concatenate([v for *_, f in ready for _, v in f]), lengths, step, slot, fixed, len(ready))
            c, trace = np.stack([r[3] for r in ready]), []
            for _ in range(rounds):
                a, b, e = block.sums(c, limit)
                c = np.linalg.solve(a + bending, b)
                trace.append(np.sqrt(e[:, 0] / e[:, 1]))
            ids = [pa.array([r[i] for r in ready], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            lists = [pa.array(list(x.reshape(len(ready), -1)), pa.list_(pa.float64())) for x in (c, np.stack(trace, axis=1))]
            ready.clear()
            return pa.RecordBatch.from_arrays([*ids, lists[0], pa.array(e[:, 1], pa.float64()), pa.array(trace[-1], pa.float64()), lists[1]], names=["video_id", "reference", "step", "coefficients", "n", "rms", "trace"])

        now, frames, held = None, [], 0
        for batch in batches:
            for video, frame, step, v in zip(*(batch.column(c).to_pylist() for c in ("video_id", "frame_id", "step")), _lists(batch.column("v")), strict=True):
                if (video, step) != now:
                    if frames:
                        start(*now, frames)
                    if held >= TOGETHER and ready:
                        yield flush()
                        held = 0
                    now, frames = (video, step), []
                v = v.reshape(-1, 5)
                frames.append((frame, v))
                held += len(v)
        if frames:
            start(*now, frames)
        if ready:
            yield flush()

    ordered = rows.select("video_id", "frame_id", "step", "v").repartition("video_id").sortWithinPartitions("video_id", "frame_id")
    return ordered.mapInArrow(fit, f"{_FIELD}, n double, rms double, trace array<double>")


def _equations(frames: DataFrame, fields: DataFrame, lattice: Lattice, limit: float) -> DataFrame:
    """(``video_id, pos, value``): the sums of the normal equations: upper triangle, both right sides, squared error and count."""
    k = lattice.size
    upper = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            ids, sums = list(held), [pa.array(s) for s in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(np.arange(len(ids) + 1) * len(sums[0]), pa.concat_arrays(sums))], names=["video_id", "sums"])

        for batch in batches:
            lists, lengths = _lists(batch.column("v")), np.diff(batch.column("v").offsets.to_numpy()) // 5
            video, frame, reference, step = (batch.column(n).to_numpy() for n in ("video_id", "frame_id", "reference", "step"))
            fields_, rows_ = _lists(batch.column("coefficients")), np.flatnonzero(lengths >= 3)
            for part in np.split(rows_, np.flatnonzero(np.diff(np.cumsum(lengths[rows_]) // TOGETHER)) + 1):
                if not len(part):
                    continue
                ids, first, slot = np.unique(video[part], return_index=True, return_inverse=True)
                block = _Block(lattice, np.concatenate([lists[i] for i in part]).reshape(-1, 5), lengths[part], step[part], slot, frame[part] == reference[part], len(ids))
                a, b, e = block.sums(np.stack([fields_[i] for i in part[first]]).reshape(-1, k, 2), limit)
                for i, key in enumerate(ids.tolist()):
                    own = np.concatenate([a[i][upper], b[i].ravel(), e[i]])
                    held[key] = held[key] + own if key in held else own
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    joined = frames.join(fields, "video_id").select("video_id", "frame_id", "v", "reference", "step", "coefficients")
    sums = joined.mapInArrow(add, "video_id long, sums array<double>")
    return sums.select("video_id", F.posexplode("sums").alias("pos", "value")).groupBy("video_id", "pos").agg(F.sum("value").alias("value"))


def fitted_fields(frames: DataFrame, steps: DataFrame, lattice: Lattice, smooth: float = 0.01, limit: float = 1.5, rounds: int = 10, still: float = 1e-4, tau: float = 0.05) -> DataFrame:
    """(``video_id, reference, step, coefficients, n, rms``): the field of each video after poses and field were fitted in turns.

    ``frames`` are the train frames. The reference frame keeps its pose, so the field is anchored. Bending of the lattice counts by ``smooth``.
    The turns end after ``rounds`` or when no video's rms changes by more than ``still`` pixels. ``rms`` is that of the last pass, under the field before it.
    """
    scratch = Scratch(frames.sparkSession, "calibration")
    rows = scratch.save(_flat(frames).withColumn("n", F.size("v") / 5), "frames")
    videos = scratch.save(rows.groupBy("video_id").agg(F.sum("n").alias("points")).join(steps, "video_id"), "videos")
    whole = rows.drop("n").join(videos.where(F.col("points") <= WHOLE), "video_id")
    cut = rows.drop("n").join(videos.where(F.col("points") > WHOLE), "video_id")
    k = lattice.size
    upper, bending = np.triu_indices(k), smooth * lattice.bending() + 1e-9 * np.eye(k)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n, rms = [], [], []
            for sums in batch.column("sums").to_pylist():
                s = np.array(sums)
                a = np.zeros((k, k))
                a[upper] = s[: len(upper[0])]
                a = a + np.triu(a, 1).T + bending
                out.append(np.linalg.solve(a, s[len(upper[0]) : -2].reshape(k, 2)).ravel().tolist())
                n.append(s[-1])
                rms.append(float(np.sqrt(s[-2] / s[-1])))
            columns = [*batch.columns[:3], pa.array(out, pa.list_(pa.float64())), pa.array(n, pa.float64()), pa.array(rms, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["video_id", "reference", "step", "coefficients", "n", "rms"])

    fields = scratch.save(_whole_fits(whole, lattice, smooth, limit, rounds, tau), "whole")
    rms = lambda t: F.get("trace", F.lit(t)) if t >= 0 else F.lit(float("inf"))
    moving = fields.agg(*[F.max(F.abs(rms(t) - rms(t - 1)) > still) for t in range(rounds)]).first()
    large = not videos.where(F.col("points") > WHOLE).isEmpty()
    if large:
        chunk = F.pmod(F.hash("frame_id"), F.ceil(F.col("points") / WHOLE))
        chunks = scratch.save(cut.withColumn("chunk", chunk).repartition("video_id", "chunk").sortWithinPartitions("video_id", "chunk").select("video_id", "frame_id", "step", "v"), "chunks")
        held = scratch.save(_starts(chunks, lattice, tau).withColumns({"n": F.lit(0.0), "rms": F.lit(float("inf"))}), "field0")
    for turn in range(1, rounds + 1):
        moves = bool(moving[turn - 1])
        if large:
            sums = _equations(chunks.drop("step"), held.select("video_id", "reference", "step", "coefficients"), lattice, limit)
            total = sums.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l"))  # as many as the lattice asks for
            ready = held.select("video_id", "reference", "step").join(total, "video_id").select("video_id", "reference", "step", F.col("l.value").alias("sums"))
            new = ready.mapInArrow(solve, f"{_FIELD}, n double, rms double").join(held.select("video_id", F.col("rms").alias("before")), "video_id")
            held = scratch.save(new, f"field{turn}")
            scratch.drop(f"field{turn - 1}")
            moves = moves or not held.where(F.abs(F.col("rms") - F.col("before")) > still).isEmpty()
            held = held.drop("before")
        if not moves:
            break
    if turn < rounds:  # all are still before their last turn, which shows only when all have been fitted
        fields = scratch.save(_whole_fits(whole, lattice, smooth, limit, turn, tau), "still")
    fields = fields.drop("trace")
    return fields.unionByName(held) if large else fields


def field_errors(frames: DataFrame, fields: DataFrame, lattice: Lattice, heldout: bool, limit: float = 1.5) -> DataFrame:
    """(``video_id, frame_id, error``) of the points of frames under the field of their video, in pixels of the rectified picture.

    With ``heldout`` the even points of a frame give its pose and the odd ones are scored, three on either side at least; else all do both.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lengths = _lists(batch.column("v")), np.diff(batch.column("v").offsets.to_numpy()) // 5
            ids, frames_, steps = (batch.column(n).to_numpy() for n in ("video_id", "frame_id", "step"))
            fields_, rows_ = _lists(batch.column("coefficients")), np.flatnonzero(lengths >= (6 if heldout else 3))
            for part in np.split(rows_, np.flatnonzero(np.diff(np.cumsum(lengths[rows_]) // TOGETHER)) + 1):
                if not len(part):
                    continue
                v, n = np.concatenate([lists[i] for i in part]).reshape(-1, 5), lengths[part]
                starts, row = np.cumsum(n) - n, np.repeat(np.arange(len(part)), n)
                c = np.stack([fields_[i] for i in part]).reshape(len(part), -1, 2)
                at, w = lattice.design(v[:, 2], v[:, 3])
                z = v[:, 2] + 1j * v[:, 3] + np.einsum("nk,nk->n", w, (c[..., 0] + 1j * c[..., 1])[row[:, None], at])
                q = steps[part][row] * (v[:, 0] + 1j * v[:, 1])
                odd = (np.arange(len(v)) - starts[row]) % 2 == 1
                own = ~odd if heldout else np.ones(len(v), bool)
                turn, shift = robust_rigids(q[own], z[own], v[own, 4], np.cumsum((n + 1) // 2) - (n + 1) // 2 if heldout else starts, limit)
                scored = odd if heldout else own
                off = np.abs(shift[row] + turn[row] * q - z)[scored]
                at = part[row][scored]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(frames_[at], pa.int64()), pa.array(off, pa.float64())], names=["video_id", "frame_id", "error"])

    joined = _flat(frames).join(fields.select("video_id", "step", "coefficients"), "video_id").select("video_id", "frame_id", "v", "step", "coefficients")
    return joined.mapInArrow(score, "video_id long, frame_id long, error double")


def fold_checks(fields: DataFrame, lattice: Lattice, tau: float = 0.05) -> DataFrame:
    """(``video_id, sound, least_determinant, least_stretch, reason``) of every field."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lattice.folds(np.array(c).reshape(-1, 2), tau) for c in batch.column("coefficients").to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.float64(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), *arrays], names=["video_id", "sound", "least_determinant", "least_stretch", "reason"])

    return fields.select("video_id", "coefficients").mapInArrow(check, "video_id long, sound boolean, least_determinant double, least_stretch double, reason string")

