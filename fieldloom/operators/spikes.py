"""Faulty readings of a measurement series, judged by what is normal for its own source.

A reading is faulty if it is impossible (not finite or out of bounds), if it is a spike, or if it is
stuck (one of several successive readings that are exactly equal). Spikes are found by phase-space
thresholding: the reading less its running median, its first and its second difference are points in
a space in which a robust ellipsoid, its axes scaled by median deviations and by the expected maximum
of as many normal values, holds the usual ones. Readings outside are replaced by interpolation and
the ellipsoid is applied again until none is new. A candidate is then kept if it, or the short run
that it is in, lies far from the course on both sides while both sides agree.

A source may hold any part of all rows, so it is cut into chunks of the order column. One pass takes
from each chunk its scatter and its outermost readings; the scatter of a source is the median over its
chunks, weighted by readings, and each chunk gets the readings next to it on either side. The second
pass judges each chunk by these. No task or row ever holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.storage import Scratch


@dataclass(frozen=True)
class Field:
    """A reading: one or more columns that are missing together, and what is possible for it.

    ``parts`` are groups of columns whose distance is judged together (a position's x and y); ``low``
    and ``high`` bound each column, ends included. ``steps`` says whether the usual scatter is the
    usual step from one reading to the next (for series that move) or the deviation about a level.
    """

    name: str
    columns: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    parts: tuple[tuple[int, ...], ...] = ((0,),)
    steps: bool = False


#: Width of a chunk on the order column; readings that a chunk gets from either side.
CHUNK, HALO = 4096, 8
#: Successive equal readings that count as stuck; at most HALO - 2, so that no run is cut short.
STUCK = 6
#: Times the usual scatter that a spike stands apart, longest spike in readings, readings of the course on either side.
APART, LONGEST, COURSE = 8.0, 5, 3
#: Share of a spike's height by which the courses before and after it may differ.
RETURN = 0.5
#: A spike needs a reading of the course on either side.
FEWEST = 3


def possible(values: np.ndarray, field: Field) -> np.ndarray:
    """Which rows of ``values`` are finite and within the bounds."""
    with np.errstate(invalid="ignore"):
        return (np.isfinite(values) & (values >= field.low) & (values <= field.high)).all(axis=1)


def equal_runs(values: np.ndarray, begins: Sequence[int] | np.ndarray = (0,)) -> np.ndarray:
    """The length of the run of exactly equal rows that each row is in; series begin at ``begins``."""
    if not len(values):
        return np.zeros(0, int)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]).any(axis=1)
    new[begins] = True
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def _distance(values: np.ndarray) -> np.ndarray:
    square = values[:, 0] * values[:, 0]
    for k in range(1, values.shape[1]):
        square += values[:, k] * values[:, k]
    return np.sqrt(square)


def usual_scatter(values: np.ndarray, steps: bool) -> float:
    """The usual step between neighbours, or the deviation that such steps have about a level.

    Where most steps are exactly 0 it is the usual one of the others, and 0 where a course does not move but for
    one departure (two steps at most). NaN of fewer than two readings.
    """
    if len(values) < 2:
        return float("nan")
    step = np.sort(_distance(np.diff(values, axis=0)))
    usual = step[(len(step) - 1) // 2]
    if usual == 0:
        moving = step[step > 0]
        usual = moving[(len(moving) - 1) // 2] if len(moving) > 2 else 0.0
    return float(usual if steps else usual / 0.6745 / np.sqrt(2))


@dataclass(frozen=True)
class _Series:
    """Several series one after the other: where each begins and its length, and of each row its series, the first and the last row of that."""

    begins: np.ndarray
    lengths: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> _Series:
        begins = np.cumsum(lengths) - lengths
        number = np.repeat(np.arange(len(lengths)), lengths)
        return _Series(begins, lengths, number, begins[number], (begins + lengths - 1)[number])

    def middle(self, values: np.ndarray) -> np.ndarray:
        """The upper median of each column in each series."""
        part = values.copy()
        for begin, n in zip(self.begins.tolist(), self.lengths.tolist(), strict=True):
            part[begin : begin + n].partition(n // 2, axis=0)
        return part[self.begins + self.lengths // 2]

    def running_median(self, values: np.ndarray, width: int, rows: np.ndarray) -> np.ndarray:
        """The median of each column over ``width`` rows around each of ``rows``, the ends repeated."""
        half = width // 2
        low, high = self.low[rows], self.high[rows]
        windows = np.stack([values[np.clip(rows + k, low, high)] for k in range(-half, half + 1)], axis=-1)
        windows.partition(half, axis=-1)
        return windows[..., half]

    def slope(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Half the difference of the rows on either side of each of ``rows``, at an end the difference to the only one."""
        low, high = np.maximum(rows - 1, self.low[rows]), np.minimum(rows + 1, self.high[rows])
        return (values[high] - values[low]) / (high - low)[:, None]

    def around(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The rows that are ``width`` or less from one of ``rows``, in the series beside it too."""
        n = len(self.number)
        if len(rows) * 8 < n:
            near = np.unique(rows[:, None] + np.arange(-width, width + 1))
            return near[(near >= 0) & (near < n)]
        near = np.zeros(n + 2 * width, bool)
        for k in range(2 * width + 1):
            near[rows + k] = True
        return np.flatnonzero(near[width : n + width])


class _Bridges:
    """One column of several series, with straight lines where readings are taken out; at an end of a series the only reading."""

    def __init__(self, values: np.ndarray, of: _Series):
        self.values, self.of = values, of
        self.out = np.zeros(len(values), bool)
        place = np.arange(len(values))
        #: Of each row taken out one further on, back and forth, with none left between.
        self.further = {-1: place - 1, 1: place + 1}

    def _left(self, rows: np.ndarray, step: int) -> np.ndarray:
        """The next row that is left beside each of ``rows``, or one beyond the end of its series."""
        at, low, high = rows + step, self.of.low[rows], self.of.high[rows]
        while True:
            go = np.flatnonzero((at >= low) & (at <= high))
            go = go[self.out[at[go]]]
            if not len(go):
                self.further[step][rows] = at
                return at
            at[go] = self.further[step][at[go]]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take ``rows`` out; the rows of their gaps and the values there. Each series must keep one."""
        self.out[rows] = True
        low, high = self.of.low[rows], self.of.high[rows]
        before, after = self._left(rows, -1), self._left(rows, 1)
        before, one = np.unique(before, return_index=True) if len(rows) > 1 else (before, slice(None))
        after, low, high = after[one], low[one], high[one]
        n = after - before - 1
        gap = np.repeat(before + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
        before, after = np.where(before < low, after, before), np.where(after > high, before, after)
        inside = after > before
        rise = (self.values[after] - self.values[before]) / np.where(inside, after - before, 1)
        base = self.values[before]
        return gap, np.where(np.repeat(inside, n), np.repeat(rise, n) * (gap - np.repeat(before, n)) + np.repeat(base, n), np.repeat(base, n))


def phase_space(series: np.ndarray, of: _Series) -> np.ndarray:
    """Which rows have a column outside the ellipsoid of their series of value, first and second difference in any round.

    The axes are those of the first round: medians are not moved by spikes, and an ellipsoid that shrank
    with every reading taken out would in the end hold none. A series has FEWEST rows or more.
    """
    reach = np.sqrt(2 * np.log(of.lengths))[:, None]
    now = series.copy()
    bridges = [_Bridges(np.ascontiguousarray(series[:, k]), of) for k in range(series.shape[1])]
    left = np.repeat(of.lengths[:, None], len(bridges), axis=1)
    closed = np.zeros(len(of.lengths), bool)
    rows = np.arange(len(series))
    u, du, ddu = np.empty_like(now), np.empty_like(now), np.empty_like(now)
    usual: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):  # every round flags a reading more; what is not near those that were replaced stays as it is
        u[rows] = now[rows] - of.running_median(now, 2 * LONGEST + 1, rows)
        rows = of.around(rows, 1)
        du[rows] = of.slope(u, rows)
        rows = of.around(rows, 1)
        ddu[rows] = of.slope(du, rows)
        number = of.number[rows]
        total = np.zeros((len(rows), len(bridges)))
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, axis in enumerate((u, du, ddu)):
                if k == len(usual):
                    centre = of.middle(axis)
                    scale = of.middle(np.abs(axis - centre[of.number])) / 0.6745
                    usual.append((centre, reach * scale))
                off, scale = np.abs(axis[rows] - usual[k][0][number]), usual[k][1][number]
                total += np.where(scale > 0, (off / scale) ** 2, np.where(off > 0, 2.0, 0.0))
        new = (total > 1) & ~np.stack([b.out[rows] for b in bridges], axis=1) & ~closed[number, None]
        hit = np.flatnonzero(new.any(axis=1))
        rows, number, new = rows[hit], number[hit], new[hit]
        more = np.stack([np.bincount(number[new[:, k]], minlength=len(closed)) for k in range(len(bridges))], axis=1)
        # A series of which a column would keep no reading stays as it is.
        closed |= (more == left).any(axis=1)
        new &= ~closed[number, None]
        left -= np.where(closed[:, None], 0, more)
        changed = [np.empty(0, int)]
        for k in np.flatnonzero(new.any(axis=0)):
            gap, value = bridges[k].take(rows[new[:, k]])
            other = value != now[gap, k]
            now[gap, k] = value
            changed.append(gap[other])
        rows = of.around(np.concatenate(changed), LONGEST)
    return np.any([b.out for b in bridges], axis=0)


def _course(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The medians of the rows from ``first`` up to ``end``, each of COURSE (three) rows or fewer."""
    a, b, c = values[first], values[np.minimum(first + 1, end - 1)], values[end - 1]
    few = (end - first)[:, None]
    return np.where(few == COURSE, np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), np.where(few == 2, (a + c) / 2, a))


def _standing_apart(values: np.ndarray, of: _Series, candidate: np.ndarray, scale: np.ndarray) -> np.ndarray:
    found = np.zeros(len(values), bool)
    candidates = np.flatnonzero(candidate)
    for length in range(1, LONGEST + 1):
        first = candidates[(candidates > of.low[candidates]) & (candidates + length <= of.high[candidates])]
        for k in range(1, length):
            first = first[candidate[first + k]]
        if not len(first):
            break
        back = _course(values, np.maximum(first - COURSE, of.low[first]), first)
        on = _course(values, first + length, np.minimum(first + length + COURSE, of.high[first] + 1))
        least = np.full(len(first), np.inf)
        for k in range(length):
            for side in (back, on):
                least = np.minimum(least, _distance(values[first + k] - side))
        hit = first[(least > APART * scale[of.number[first]]) & (_distance(on - back) < RETURN * least)]
        found[(hit[:, None] + np.arange(length)[None]).ravel()] = True
    return found


def spikes(values: np.ndarray, lengths: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Which rows are spikes: candidates of the phase space that stand apart from a course that goes on.

    ``values`` are series one after the other, with a length and a usual scatter each. The rows found are taken out
    and the rest of their series is judged again, as a spike may hide another near it. A scale of 0 is that of a
    course that stands still: any departure that comes back is a spike.
    """
    found = np.zeros(len(values), bool)
    number = np.repeat(np.arange(len(lengths)), lengths)
    left = np.flatnonzero((scale >= 0)[number])
    while True:
        n = np.bincount(number[left], minlength=len(lengths))
        left = left[n[number[left]] >= FEWEST]
        if not len(left):
            return found
        open_ = np.flatnonzero(n >= FEWEST)
        rest, of = values[left], _Series.of(n[open_])
        new = _standing_apart(rest, of, phase_space(rest, of), scale[open_])
        found[left[new]] = True
        again = np.zeros(len(lengths), bool)
        again[number[left[new]]] = True
        left = left[~new & again[number[left]]]


def faults(values: np.ndarray, field: Field, scale: Sequence[float] | np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Which readings of an ordered series are faulty; ``scale`` has the usual scatter of each part.

    With ``lengths`` the values are of several series one after the other, and ``scale`` has a row for each.
    """
    lengths = np.array([len(values)]) if lengths is None else lengths
    scale = np.asarray(scale, float).reshape(len(lengths), len(field.parts))
    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
    good = possible(values, field)
    stuck = equal_runs(values, begins) >= STUCK
    bad = ~good | stuck
    free = np.flatnonzero(good & ~stuck)
    left = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[free], minlength=len(lengths))
    for i, part in enumerate(field.parts):
        bad[free[spikes(values[free][:, list(part)], left, scale[:, i])]] = True
    return bad


def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The sorted rows of a partition, cut where any of the first ``keys`` columns changes."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
            if held:
                change[0] |= c[0] != held[-1].column(i)[-1].as_py()
        at = 0
        for cut in np.flatnonzero(change):
            if cut > at:
                held.append(table.slice(at, cut - at))
            if held:
                yield pa.concat_tables(held)
            held, at = [], cut
        held.append(table.slice(at))
    if held:
        yield pa.concat_tables(held)


def _changes(table: pa.Table, keys: int) -> np.ndarray:
    """Which rows are the first or differ in any of the first ``keys`` columns from the row before."""
    new = np.ones(table.num_rows, bool)
    columns = [table.column(i).to_numpy() for i in range(keys)]
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


#: Rows whose chunks are judged together.
TOGETHER = 100_000


def _together(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The sorted rows of a partition, cut between chunks where ``TOGETHER`` of them have come."""
    held: list[pa.RecordBatch] = []
    rows, most = 0, TOGETHER
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(_changes(table, keys))[-1])
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        most = max(TOGETHER, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _once(table: pa.Table) -> pa.Table:
    """Rows sorted by place and item, without later copies of an item."""
    item, at = _column(table, "item"), _column(table, "at")
    keep = np.ones(len(item), bool)
    keep[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1])
    return table.filter(pa.array(keep))


def flag_faults(df: DataFrame, source: str, order: str, item: str, fields: Sequence[tuple[Field, Sequence[Column]]]) -> DataFrame:
    """The faulty readings (``item``, ``field``) of a table of readings.

    ``source``, ``order`` and ``item`` are integer columns: the series, the place in it, and the
    identifier of a result, which breaks ties of place. Rows with a null in any of them are left
    out, copies of an item at its place count once. Each field comes with the columns of its values; it
    is missing where any of them is null, and then never faulty. NaN and infinity are readings that
    are impossible. An empty table gives no rows; further columns are ignored. The scatter of a source is the
    median over its chunks; where no chunk has two readings it is that of the readings around each chunk. The
    first and the last reading of a source have no course on one side and are never spikes.
    """
    specs = [f for f, _ in fields]
    names = [f"v{i}" for i in range(sum(len(f.columns) for f in specs))]
    starts = np.cumsum([0, *[len(f.columns) for f in specs]])
    values = [c.cast("double") for _, cs in fields for c in cs]
    rows = (
        df.select(F.col(source).cast("long").alias("source"), F.floor(F.col(order) / CHUNK).alias("chunk"), F.lit(0).alias("kind"),
                  F.col(order).cast("long").alias("at"), F.col(item).cast("long").alias("item"),
                  *[v.alias(n) for v, n in zip(values, names, strict=True)])
        .dropna(subset=["source", "at", "item"])
    )
    width = max(len(f.columns) for f in specs)

    def readings(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows at which field k is not missing, and its values there."""
        cols = [table[names[i]] for i in range(starts[k], starts[k + 1])]
        there = np.ones(table.num_rows, bool)
        for c in cols:
            there &= ~c.is_null().to_numpy()
        at = np.flatnonzero(there)
        return at, np.stack([c.to_numpy()[at].astype(float) for c in cols], axis=1)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 2):
            chunk = _once(chunk)
            out = []
            for k, field in enumerate(specs):
                _, v = readings(chunk, k)
                if len(v):
                    free = v[possible(v, field) & (equal_runs(v) < STUCK)]
                    scale = [usual_scatter(free[:, list(p)], field.steps) for p in field.parts]
                    out.append((chunk["source"][0].as_py(), chunk["chunk"][0].as_py(), k, len(free), scale, v[:HALO].tolist(), v[-HALO:].tolist()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, summary_schema.types, strict=True)], schema=summary_schema)

    summary_schema = pa.schema([
        ("source", pa.int64()), ("chunk", pa.int64()), ("field", pa.int32()), ("n", pa.int64()), ("scale", pa.list_(pa.float64())),
        ("head", pa.list_(pa.list_(pa.float64()))), ("tail", pa.list_(pa.list_(pa.float64()))),
    ])
    placed = rows.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "at", "item")
    summed = Scratch(df.sparkSession, "faults").save(placed.mapInArrow(summary, "source long, chunk long, field int, n long, scale array<double>, head array<array<double>>, tail array<array<double>>"), "summary")
    # Every summary has a reading, so HALO of them hold HALO readings at least.
    by = Window.partitionBy("source", "field").orderBy("chunk")
    beside = summed.withColumn("before", F.flatten(F.collect_list("tail").over(by.rowsBetween(-HALO, -1)))).withColumn(
        "after", F.flatten(F.collect_list("head").over(by.rowsBetween(1, HALO)))
    )
    parts = max(len(f.parts) for f in specs)
    scales = summed.groupBy("source", "field").agg(
        # A chunk that stands still says nothing where others move.
        *[F.expr(f"coalesce(percentile(if(isnan(get(scale, {p})) OR get(scale, {p}) = 0, null, get(scale, {p})), 0.5D, greatest(n, 1L)), max(if(get(scale, {p}) = 0, 0D, null)))").alias(f"p{p}") for p in range(parts)]
    )
    context = (
        beside.join(scales, ["source", "field"])
        .select("source", "chunk", "field", *[f"p{p}" for p in range(parts)],
                F.expr(f"slice(before, greatest(1, size(before) - {HALO - 1}), {HALO})").alias("before"), F.expr(f"slice(after, 1, {HALO})").alias("after"))
    )
    scale_rows = context.select("source", "chunk", F.lit(-1).alias("kind"), F.col("field").cast("long").alias("at"), F.lit(0).cast("long").alias("item"),
                                *[(F.col(f"p{i}") if i < parts else F.lit(None).cast("double")).alias(n) for i, n in enumerate(names)])

    def halo(side: str, kind: int) -> DataFrame:
        values = [F.expr(f"get(value, {i})") if i < width else F.lit(None).cast("double") for i in range(len(names))]
        return context.select("source", "chunk", F.col("field"), F.posexplode(side).alias("pos", "value")).select(
            "source", "chunk", (F.lit(kind) + F.col("field")).cast("int").alias("kind"), F.col("pos").cast("long").alias("at"), F.lit(0).cast("long").alias("item"),
            *[v.alias(n) for v, n in zip(values, names, strict=True)],
        )

    total = rows.unionByName(scale_rows).unionByName(halo("before", 100)).unionByName(halo("after", 200))
    labels = [f.name for f in specs]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _together(batches, 2):
            kind, at, items = (_column(whole, c) for c in ("kind", "at", "item"))
            first = _changes(whole, 2)
            group = np.cumsum(first) - 1
            copy = np.zeros(len(kind), bool)
            copy[1:] = (items[1:] == items[:-1]) & (at[1:] == at[:-1]) & (kind[1:] == 0) & (kind[:-1] == 0) & ~first[1:]
            own = (kind == 0) & ~copy
            values = np.stack([whole[n].to_numpy().astype(float) for n in names], axis=1)
            for k, field in enumerate(specs):
                here = np.arange(starts[k], starts[k + 1])
                there = own.copy()
                for i in here:
                    there &= ~whole[names[i]].is_null().to_numpy()
                if not there.any():
                    continue
                beyond = (kind == 100 + k) | (kind == 200 + k)
                rows = np.flatnonzero(there | beyond)
                # The readings before a chunk, its own, those after it.
                rows = rows[np.argsort(3 * group[rows] + np.where(kind[rows] == 0, 1, np.where(kind[rows] == 100 + k, 0, 2)), kind="stable")]
                series = np.where(beyond[rows, None], values[rows, : len(here)], values[np.ix_(rows, here)])
                numbers, lengths = np.unique(group[rows], return_counts=True)
                scaled = np.flatnonzero((kind == -1) & (at == k))
                scale = values[scaled[np.searchsorted(group[scaled], numbers)], : len(field.parts)]
                for i in np.flatnonzero(np.isnan(scale).any(axis=1)):  # no chunk of the source has two readings: its steps are those from chunk to chunk
                    v = series[group[rows] == numbers[i]]
                    free = v[possible(v, field) & (equal_runs(v) < STUCK)]
                    scale[i] = np.where(np.isnan(scale[i]), [usual_scatter(free[:, list(p)], field.steps) for p in field.parts], scale[i])
                hit = items[rows[faults(series, field, scale, lengths) & ~beyond[rows]]]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array([labels[k]] * len(hit), pa.string())], names=[item, "field"])

    sorted_rows = total.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "kind", "at", "item")
    return sorted_rows.mapInArrow(judge, f"`{item}` long, field string")


#: A position beyond this many pixels is out of reach of any stage.
REACH = 1e7


def match_faults(entries: DataFrame) -> DataFrame:
    """Faulty ``pose``, ``score`` and ``psr`` readings of the matches of a path, per video."""
    m = F.col("incremental_match")
    inf = float("inf")
    pose = Field("pose", ("x", "y", "rotation"), (-REACH, -REACH, -np.pi), (REACH, REACH, np.pi), ((0, 1), (2,)), steps=True)
    score = Field("score", ("score",), (-1.0,), (1.0,))
    psr = Field("psr", ("psr",), (0.0,), (inf,))
    return flag_faults(entries, "video_id", "frame", "entry_no", [
        (pose, [m["pose"]["x"], m["pose"]["y"], m["pose"]["rotation"]]), (score, [m["score"]]), (psr, [m["psr"]])
    ]).dropDuplicates()
