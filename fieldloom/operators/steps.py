"""Ordered rules that depend on what was chosen before, and budgets over plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import pose as P
from fieldloom.operators import windows
from fieldloom.storage import Scratch


def chosen_in_order(df: DataFrame, track: str, order: str, start: Callable[[], Any], choose: Callable[[Any, dict[str, np.ndarray], int], tuple[bool, Any]]) -> DataFrame:
    """The rows that ``choose`` takes, walking each track in order; it gets the state, the columns and the row, and gives the next state.

    Rows stream by in sorted batches, so a task holds a batch and one state, however long a track is. Columns
    hold no nulls.
    """
    rows = df.repartition(track).sortWithinPartitions(track, order)
    at = df.columns.index(track)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            columns = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            keep = np.zeros(batch.num_rows, bool)
            tracks = batch.column(at).to_pylist()
            for row, key in enumerate(tracks):
                if key != now:
                    now, state = key, start()
                keep[row], state = choose(state, columns, row)
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(walk, df.schema)


def context_frames(path: DataFrame, track: str, order: str, score: str, interval: int = 8) -> DataFrame:
    """The rows at which a surrounding search runs: the first, those ``interval`` or more after the last one that ran, and those of a score below 0.75."""
    if interval < 1:
        raise ValueError("interval must be 1 or more")
    rows = path.select(track, order, F.coalesce(F.col(score).cast("double"), F.lit(float("inf"))).alias("score"))

    def choose(last: int | None, columns: dict[str, np.ndarray], row: int) -> tuple[bool, int | None]:
        frame = columns[order][row]
        runs = last is None or frame - last >= interval or columns["score"][row] < 0.75
        return runs, frame if runs else last

    return chosen_in_order(rows, track, order, lambda: None, choose).select(track, order)


def within_budget(chains: DataFrame, group: Sequence[str], chain: Sequence[str], length: str, budget: int) -> DataFrame:
    """The links of the chains of each group that a budget of links allows, shortest chains first, then by their columns.

    As chains come by rising length, none after the first that does not fit can fit; so it is a running sum.
    """
    each = chains.select(*group, *chain, length).distinct()
    order = Window.partitionBy(*group).orderBy(length, *chain).rowsBetween(Window.unboundedPreceding, 0)
    taken = each.withColumn("spent", F.sum(length).over(order)).where(F.col("spent") <= budget)
    return chains.join(taken.select(*group, *chain), [*group, *chain], "left_semi")


def intermediate_frames(path: DataFrame, keyframes: DataFrame, track: str, order: str, budget: int) -> DataFrame:
    """Up to ``budget`` frames of each track between its keyframes: half by how far they are from the line of their neighbours, the rest evenly spread.

    Where the even ones fall on frames taken already, the first free ones fill up.
    """
    odd = windows.anomalies(path, track, order)
    free = odd.join(keyframes.select(track, order), [track, order], "left_anti")
    by = Window.partitionBy(track)
    half = -(-budget // 2)
    ranked = free.withColumns({
        "i": F.row_number().over(by.orderBy(order)) - 1, "n": F.count("*").over(by), "odd": F.row_number().over(by.orderBy(F.desc("anomaly"), order)),
    })
    whole = ranked.where(F.col("n") <= budget)
    more = ranked.where(F.col("n") > budget).withColumn("first", F.col("odd") <= half)
    # Even place k of as many as the other half of the budget is row floor((k + 0.5) n / half); k runs on until the budget is spent.
    rest = max(1, budget - half)
    k = F.floor(F.col("i") * rest / F.col("n"))
    hit = lambda j: (j >= 0) & (F.floor((j + 0.5) * F.col("n") / rest) == F.col("i"))
    even = F.when(hit(k - 1), k - 1).when(hit(k), k).when(hit(k + 1), k + 1)
    turned = more.withColumn("even", F.when(~F.col("first") & (even < rest), even))
    queue = by.orderBy(F.desc("first"), F.col("even").asc_nulls_last(), order)
    filled = turned.withColumn("place", F.row_number().over(queue)).where(F.col("place") <= budget)
    return whole.select(track, order).unionByName(filled.select(track, order))


def farthest_points(points: DataFrame, track: str, order: str, limit: int = 12) -> DataFrame:
    """Up to ``limit`` rows of each track: the last, the first, and then always the one farthest from all chosen, ties by order.

    Each of the few rounds is one pass with a maximum per track; nothing of a track is gathered.
    """
    scratch = Scratch(points.sparkSession, "farthest")
    counts = points.groupBy(track).agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
    rows = points.select(track, order, "x", "y").join(counts, track)
    taken = (F.col(order) == F.col("high")) | ((F.col(order) == F.col("low")) if limit > 1 else F.lit(False)) | (F.col("n") <= limit)
    state = scratch.save(rows.select(track, order, "x", "y", "n", taken.alias("taken"), F.lit(float("inf")).alias("near"), taken.alias("new")), "s0")
    for k in range(1, limit):
        fresh = state.where(F.col("new") & (F.col("n") > limit)).groupBy(track).agg(F.collect_list(F.struct("x", "y")).alias("fresh"))  # two of a track at most
        away = lambda p: F.pow(F.col("x") - p["x"], 2) + F.pow(F.col("y") - p["y"], 2)  # noqa: E731, B023
        near = state.join(fresh, track).withColumn("near", F.least("near", F.array_min(F.transform("fresh", away))))
        best = near.where("NOT taken").groupBy(track).agg(F.max_by(order, F.struct("near", (-F.col(order)).alias("o"))).alias("pick"))
        done = F.col(order) == F.col("pick")
        grown = near.drop("fresh").join(best, track).select(track, order, "x", "y", "n", (F.col("taken") | done).alias("taken"), "near", done.alias("new"))
        if k + 1 < limit:
            settled = state.where(F.col("n") <= limit)
            state = scratch.save(settled.unionByName(grown), f"s{k}")
            scratch.drop(f"s{k - 1}")
    return state.where("taken").select(track, order)


def confirmed_closures(rows: DataFrame, track: str, order: str, lever: float, tolerance: float) -> DataFrame:
    """Supported rows with whether they confirm a closure: by two groups of references, or with the supported row before.

    ``rows`` has ``supported``, the correction ``x``, ``y``, ``rotation`` and ``groups``, the frames of each group of references. A row before counts if it
    comes right before in the table, its correction is within the tolerance and some references lie within 8 frames.
    """
    by = Window.partitionBy(track).orderBy(order)
    own = F.when(F.col("supported"), F.struct("x", "y", "rotation", "groups"))
    before = rows.withColumns({"own": own, "before": F.lag(own).over(by)}).where("supported")
    d = lambda c: F.col(f"own.{c}") - F.col(f"before.{c}")
    away = F.sqrt(d("x") * d("x") + d("y") * d("y")) + F.abs(P.wrap(d("rotation"))) * lever
    related = F.exists("before.groups", lambda g: F.exists("own.groups", lambda h: F.exists(g, lambda a: F.exists(h, lambda b: F.abs(a - b) <= 8))))
    independent = F.size("own.groups") >= 2
    following = F.coalesce(related & (away <= tolerance), F.lit(False))
    return before.select(track, order, independent.alias("independent"), following.alias("following"), (independent | following).alias("confirmed"))


def largest_component(labels: DataFrame, track: str) -> DataFrame:
    """Of each track the frames of its largest component (``label``), of equal ones that of the smallest label."""
    size = labels.groupBy(track, "label").agg(F.count("*").alias("n"))
    best = size.groupBy(track).agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("l"))).alias("label"))
    return labels.join(best, [track, "label"], "left_semi")


def cycle_errors(rows: DataFrame, width: float, height: float) -> DataFrame:
    """How far a measured pose is from the expected one: shift, turn, and the median, rms and 95 % of the shifts of the 256 tile centres.

    ``rows`` has the poses ``expected`` and ``measured``; other columns stay. No tile is a row: there are always 256.
    """
    e, m = F.col("expected"), F.col("measured")
    # A tile centre moves by the difference of the poses, which is linear in its place.
    parts = rows.withColumns({
        "dx": m["x"] - e["x"], "dy": m["y"] - e["y"], "dc": F.cos(m["rotation"]) - F.cos(e["rotation"]), "ds": F.sin(m["rotation"]) - F.sin(e["rotation"]),
    })
    dx, dy, dc, ds = (F.col(c) for c in ("dx", "dy", "dc", "ds"))
    tiles = F.array(*[F.struct(F.lit((k % 16 + 0.5) / 16 * width - width / 2).alias("u"), F.lit((k // 16 + 0.5) / 16 * height - height / 2).alias("v")) for k in range(256)])
    away = lambda p: F.sqrt(F.pow(dx + dc * p["u"] - ds * p["v"], 2) + F.pow(dy + ds * p["u"] + dc * p["v"], 2))
    s = parts.withColumn("s", F.sort_array(F.transform(tiles, away)))
    linear = 0.95 * 255
    between = F.get("s", F.lit(int(linear))) + (linear - int(linear)) * (F.get("s", F.lit(int(linear) + 1)) - F.get("s", F.lit(int(linear))))
    return s.select(
        *[c for c in rows.columns if c not in ("expected", "measured")], F.sqrt(dx * dx + dy * dy).alias("shift"), F.abs(P.wrap(m["rotation"] - e["rotation"])).alias("rotation"), F.get("s", F.lit(128)).alias("median"),
        F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v) / 256).alias("rms"), between.alias("p95"),
    )


def distinct_places(cells: DataFrame, group: str, order: str, reach: float) -> DataFrame:
    """The cells of each group that lie no nearer than ``reach`` to one kept before, in their order; ``x`` and ``y`` are known."""
    rows = cells.select(group, order, "x", "y")

    def choose(kept: dict, columns: dict[str, np.ndarray], row: int) -> tuple[bool, dict]:
        x, y = columns["x"][row], columns["y"][row]
        i, j = int(x // reach), int(y // reach)
        near = any((p - x) ** 2 + (q - y) ** 2 < reach * reach for a in (-1, 0, 1) for b in (-1, 0, 1) for p, q in kept.get((i + a, j + b), ()))
        if not near:
            kept.setdefault((i, j), []).append((x, y))
        return not near, kept

    return chosen_in_order(rows, group, order, dict, choose)


class _Kept:
    """The points of the frames kept so far on a grid of ``least``: the older ones sorted by cell, the last few not yet."""

    #: Points that wait unsorted.
    FEW = 1024
    #: Cells of a row of the grid.
    _ROW = 1 << 31

    def __init__(self, least: float):
        self.least, self.cell, self.frames = least, least * (1 + 1e-9), 0
        self.key, self.at, self.of = np.zeros(0, np.int64), np.zeros(0, complex), np.zeros(0, np.int64)
        self.late: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.tail = 0, None

    def _cells(self, p: np.ndarray) -> np.ndarray:
        return np.floor(p.real / self.cell).astype(np.int64) * self._ROW + np.floor(p.imag / self.cell).astype(np.int64)

    def add(self, own: np.ndarray) -> None:
        if np.isnan(np.abs(own)).any():  # no frame is near to it
            return
        own = own[np.isfinite(own)]
        self.late.append((self._cells(own), own, np.full(len(own), self.frames)))
        self.frames, self.waiting, self.tail = self.frames + 1, self.waiting + len(own), None
        if self.waiting > max(self.FEW, len(self.key) // 64):
            key, at, of = (np.concatenate(c) for c in zip((self.key, self.at, self.of), *self.late, strict=True))
            order = np.argsort(key, kind="stable")
            self.key, self.at, self.of, self.late, self.waiting = key[order], at[order], of[order], [], 0

    def near(self, own: np.ndarray) -> bool:
        """Whether the middle distance of a point to the nearest one of any kept frame is below ``least``."""
        need, p = len(own) // 2 + 1, own[np.isfinite(own)]
        if len(p) < need:
            return False
        if self.late:
            if self.tail is None:
                self.tail = [np.concatenate(c) for c in zip(*self.late, strict=True)]
            if self._enough(*np.nonzero(np.abs(p[:, None] - self.tail[1][None]) < self.least), self.tail[2], need):
                return True
        if not len(self.key):
            return False
        # Of each point the three rows of cells around it; the cells of a row lie side by side.
        mid = self._cells(p)[:, None] + np.array([-self._ROW, 0, self._ROW])
        low, high = np.searchsorted(self.key, mid.ravel() - 1), np.searchsorted(self.key, mid.ravel() + 1, "right")
        n = high - low
        point = np.repeat(np.arange(len(n)) // 3, n)
        place = np.arange(len(point)) + np.repeat(low - np.cumsum(n) + n, n)
        close = np.abs(p[point] - self.at[place]) < self.least
        return self._enough(point[close], place[close], self.of, need)

    @staticmethod
    def _enough(point: np.ndarray, place: np.ndarray, of: np.ndarray, need: int) -> bool:
        """Whether ``need`` different points are near to one frame."""
        if len(point) < need:
            return False
        width = int(point.max()) + 1
        pairs = np.unique(of[place] * width + point) // width
        return bool(np.unique(pairs, return_counts=True)[1].max() >= need)


def moved_enough(frames: DataFrame, group: Sequence[str], least: float) -> DataFrame:
    """The frames of each group, in their order, whose points have moved: to no frame kept before is the middle distance of a point to its nearest one below ``least``.

    ``frames`` has ``frame_id`` and ``points`` (``x``, ``y``). The middle distance is below ``least`` if more than half of the points are that near, so
    points look for near ones on a grid instead of in every frame kept.
    """
    k = "__group"
    rows = frames.select(F.to_json(F.struct(*group)).alias(k), "frame_id", F.transform("points", lambda p: p["x"]).alias("px"), F.transform("points", lambda p: p["y"]).alias("py"), *group)
    rows = rows.where("size(px) > 0")

    def choose(kept: _Kept, columns: dict[str, np.ndarray], row: int) -> tuple[bool, _Kept]:
        own = columns["px"][row] + 1j * columns["py"][row]
        if kept.near(own):
            return False, kept
        kept.add(own)
        return True, kept

    return chosen_in_order(rows, k, "frame_id", lambda: _Kept(least), choose).select(*group, "frame_id")
