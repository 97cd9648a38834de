"""Streaming forms of the path operators.

Every track is a keyed state. Rows of a track that come again or behind the last accepted one are dropped, as
a tracker that has gone on cannot use them; rows of one micro-batch are put in order first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom.functions import pose as P


def _in_order(frames: Iterator[pd.DataFrame], order: str, last: int) -> pd.DataFrame:
    rows = pd.concat(list(frames)).sort_values(order, kind="stable").drop_duplicates(order)
    return rows[rows[order] > last]


def stream_visits(path: DataFrame, track: str, order: str, gap: int = 256) -> DataFrame:
    """Each row of a stream with the number of its visit; a visit ends where the order jumps by more than ``gap``."""
    kind = dict(path.dtypes)[track]

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, visit = state.get if state.exists else (-1, 0)
        rows = _in_order(frames, order, last)
        if rows.empty:
            return
        at = rows[order].to_numpy()
        jumps = np.diff(at, prepend=last if last >= 0 else at[0]) > gap
        visits = visit + np.cumsum(jumps)
        state.update((int(at[-1]), int(visits[-1])))
        yield pd.DataFrame({track: key[0], order: at, "visit": visits})

    return path.select(track, F.col(order).cast("long").alias(order)).groupBy(track).applyInPandasWithState(
        number, f"`{track}` {kind}, `{order}` long, visit long", "last long, visit long", "append", GroupStateTimeout.NoTimeout
    )


def stream_stabilised(path: DataFrame, track: str, order: str, window: int) -> DataFrame:
    """Each row of a stream with the weighted mean pose of the last ``window`` rows of its track.

    The state of a track is those rows. Rows without a pose take their place in the window and have none.
    """
    kind = dict(path.dtypes)[track]
    fields = ["x", "y", "rotation", "points"]

    def smooth(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[1], float).reshape(-1, 4) if state.exists else np.zeros((0, 4))
        rows = _in_order(frames, order, state.get[0] if state.exists else -1)
        if rows.empty:
            return
        values = np.concatenate([held, rows[fields].to_numpy(float)])
        out = []
        for i in range(len(held), len(values)):
            part = values[max(0, i - window + 1) : i + 1]
            part = part[np.isfinite(part).all(axis=1)]
            if not np.isfinite(values[i]).all():
                out.append((None, None, None))
                continue
            w = np.maximum(1.0, part[:, 3])
            out.append((w @ part[:, 0] / w.sum(), w @ part[:, 1] / w.sum(), np.arctan2(w @ np.sin(part[:, 2]), w @ np.cos(part[:, 2]))))
        state.update((int(rows[order].iloc[-1]), values[len(values) - window + 1 if window > 1 else len(values) :][-(window - 1) :].ravel().tolist() if window > 1 else []))
        yield pd.DataFrame(out, columns=fields[:3]).assign(**{track: key[0], order: rows[order].to_numpy()})[[track, order, *fields[:3]]]

    return path.select(track, F.col(order).cast("long").alias(order), *[F.col(c).cast("double").alias(c) for c in fields]).groupBy(track).applyInPandasWithState(
        smooth, f"`{track}` {kind}, `{order}` long, x double, y double, rotation double", "last long, held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def failure_rates(entries: DataFrame, time: str, track: str, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Attempts and failures of each track in windows of event time; rows later than ``late`` are dropped."""
    timed = entries.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), track).agg(F.count("*").alias("attempts"), F.count(F.when(~F.col("success"), 1)).alias("failures")).select(
        F.col("window.start").alias("start"), track, "attempts", "failures"
    )


def corrected_view(poses: DataFrame, corrections: DataFrame, track: str, order: str) -> DataFrame:
    """Poses with all logged closures of their track spread over them, of a stream as of a table.

    The log (``anchor``, ``frame``, ``dx``, ``dy``, ``turn``) is read as a table; a track has few closures. Rows that were given out before a
    closure was logged are not taken back: a reader who needs them corrected reads the poses again.
    """
    span = F.col("frame") - F.col("anchor")
    log = corrections.where(span > 0).groupBy(track).agg(F.collect_list(F.struct("anchor", "frame", "dx", "dy", "turn")).alias("log"))
    at = F.col(order)
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - c["anchor"]) / (c["frame"] - c["anchor"])))
    moved = lambda name: F.coalesce(F.aggregate("log", F.lit(0.0), lambda s, c: s + share(c) * c[name]), F.lit(0.0))
    both = poses.where("x IS NOT NULL").join(log, track, "left")
    return both.select(track, order, (F.col("x") + moved("dx")).alias("x"), (F.col("y") + moved("dy")).alias("y"), P.wrap(F.col("rotation") + moved("turn")).alias("rotation"))


def stream_context(path: DataFrame, track: str, order: str, score: str, interval: int = 8) -> DataFrame:
    """The rows of a stream at which a surrounding search runs: the first of a track, those ``interval`` or more after the last one that ran, and those of a score below 0.75."""
    kind = dict(path.dtypes)[track]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (-1, None)
        rows = _in_order(frames, order, seen)
        if rows.empty:
            return
        chosen = []
        for at, low in zip(rows[order].tolist(), (rows["s"] < 0.75).tolist(), strict=True):
            if last is None or at - last >= interval or low:
                chosen.append(at)
                last = at
        state.update((int(rows[order].iloc[-1]), last))
        yield pd.DataFrame({track: [key[0]] * len(chosen), order: chosen})

    rows = path.select(track, F.col(order).cast("long").alias(order), F.coalesce(F.col(score).cast("double"), F.lit(float("inf"))).alias("s"))
    return rows.groupBy(track).applyInPandasWithState(run, f"`{track}` {kind}, `{order}` long", "seen long, last long", "append", GroupStateTimeout.NoTimeout)
