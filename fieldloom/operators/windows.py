"""Ordered operators on tracked paths: smoothing, visits, interpolation, closures, spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import pose as P
from fieldloom.functions.stats import half_up


def stabilised(path: DataFrame, track: str, order: str, window: int) -> DataFrame:
    """The weighted mean pose of the last ``window`` rows, the rotation as a circular mean.

    Rows without a pose are skipped, and a row without one has none.
    """
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("rotation").isNotNull() & F.col("points").isNotNull()
    back = Window.partitionBy(track).orderBy(order).rowsBetween(1 - window, 0)
    w = F.when(ok, F.greatest(F.lit(1.0), F.col("points")))
    total = lambda c: F.sum(w * c).over(back)
    mean = lambda c: F.when(ok, total(F.col(c)) / F.sum(w).over(back))
    turn = F.when(ok, F.atan2(total(F.sin("rotation")), total(F.cos("rotation"))))
    return path.select(track, order, mean("x").alias("x"), mean("y").alias("y"), turn.alias("rotation"))


def visits(path: DataFrame, track: str, order: str, gap: int = 256) -> DataFrame:
    """Rows with the number of their visit; a visit ends where the order column jumps by more than ``gap``."""
    by = Window.partitionBy(track).orderBy(order)
    starts = F.when(F.col(order) - F.lag(order).over(by) > gap, 1).otherwise(0)
    return path.withColumn("starts", starts).withColumn("visit", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def travelled(path: DataFrame, track: str, order: str) -> DataFrame:
    """Rows with a pose, with the length of the path up to each."""
    by = Window.partitionBy(track).orderBy(order)
    dx, dy = F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by)
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return path.where("x IS NOT NULL").withColumn("step", step).withColumn("travelled", F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def anomalies(path: DataFrame, track: str, order: str) -> DataFrame:
    """How far each pose is from the line between its neighbours; 0 at the ends, a radian counts as 100 px."""
    by = Window.partitionBy(track).orderBy(order)
    b = lambda c: F.lag(c).over(by)
    a = lambda c: F.lead(c).over(by)
    rows = path.where("x IS NOT NULL").select(track, order, "x", "y", "rotation", *[f(c).alias(f"{s}_{c}") for c in (order, "x", "y", "rotation") for s, f in (("b", b), ("a", a))])
    share = (F.col(order) - F.col(f"b_{order}")) / F.greatest(F.lit(1), F.col(f"a_{order}") - F.col(f"b_{order}"))
    off = lambda c: F.col(c) - F.col(f"b_{c}") - share * (F.col(f"a_{c}") - F.col(f"b_{c}"))
    turn = P.wrap(F.col("rotation") - F.col("b_rotation") - share * P.wrap(F.col("a_rotation") - F.col("b_rotation"))) * 100
    return rows.select(track, order, F.coalesce(F.sqrt(off("x") * off("x") + off("y") * off("y") + turn * turn), F.lit(0.0)).alias("anomaly"))


def closed_loops(path: DataFrame, closures: DataFrame, track: str, order: str) -> DataFrame:
    """Poses with the corrections of all closures of their track spread over them.

    A closure has ``anchor``, ``frame``, ``dx``, ``dy`` and ``turn``: rows after the anchor get the share of
    the span that they have passed, rows after the frame all of it. Without a span it does nothing.
    """
    span = F.col("c_frame") - F.col("c_anchor")
    c = closures.select(track, F.col("anchor").alias("c_anchor"), F.col("frame").alias("c_frame"), "dx", "dy", "turn").where(span > 0)
    share = F.least(F.lit(1.0), (F.col(order) - F.col("c_anchor")) / span)
    moves = path.where("x IS NOT NULL").select(track, order).join(c, track).where(F.col(order) > F.col("c_anchor")).groupBy(track, order).agg(
        *[F.sum(share * F.col(d)).alias(d) for d in ("dx", "dy", "turn")]
    )
    some = lambda d: F.coalesce(F.col(d), F.lit(0.0))
    both = path.where("x IS NOT NULL").join(moves, [track, order], "left")
    return both.select(track, order, (F.col("x") + some("dx")).alias("x"), (F.col("y") + some("dy")).alias("y"), P.wrap(F.col("rotation") + some("turn")).alias("rotation"))


def _beside(by_track: list[str], order: str, value: Column) -> tuple[Column, Column]:
    """The last known ``value`` up to each row and the first from it on; both frames run, the second from the end."""
    w = Window.partitionBy(*by_track)
    known = F.last(value, ignorenulls=True)
    return tuple(known.over(w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc(order), F.desc(order)))


def between_anchors(path: DataFrame, anchors: DataFrame, track: str, order: str) -> DataFrame:
    """Poses corrected by the anchors around them, by the distance travelled between these.

    ``anchors`` has ``ax``, ``ay`` and ``arotation`` for some rows of ``path``. Before the first and after the last
    anchor its correction holds; a track without anchors has no rows.
    """
    rows = travelled(path, track, order).join(anchors, [track, order], "left")
    own = P.pose("x", "y", "rotation")
    mark = F.when(F.col("ax").isNotNull(), F.struct(F.col(order).alias("at"), F.col("travelled").alias("way"),
                  P.compose(P.pose("ax", "ay", "arotation"), P.invert(own)).alias("fix")))
    left, right = _beside([track], order, mark)
    near = rows.withColumns({"l": left, "r": right}).where("l IS NOT NULL OR r IS NOT NULL")
    l, r = F.coalesce("l", "r"), F.coalesce("r", "l")
    way = r["way"] - l["way"]
    share = F.when(l["at"] == r["at"], 0.0).when(way > 1e-8, (F.col("travelled") - l["way"]) / way).otherwise((F.col(order) - l["at"]) / (r["at"] - l["at"]))
    fixed = near.select(track, order, own.alias("own"), l["fix"].alias("lf"), r["fix"].alias("rf"), share.alias("share"))
    fix = F.when(F.col("share") == 0, F.col("lf")).otherwise(P.interpolate(F.col("lf"), F.col("rf"), F.col("share")))
    moved = P.bound(F.struct(fix.alias("fix"), F.col("own").alias("own")), lambda v: P.compose(v["fix"], v["own"]))
    return fixed.select(track, order, F.inline(F.array(moved)))


def within_visits(path: DataFrame, anchors: DataFrame, track: str, order: str, gap: int = 256) -> DataFrame:
    """Poses of rows without an anchor, moved as the anchors around them in their visit, by order.

    Before the first and after the last anchor of a visit its motion holds; rows of visits without any are not given.
    """
    rows = visits(path.where("x IS NOT NULL"), track, order, gap).join(anchors, [track, order], "left")
    mark = F.when(F.col("ax").isNotNull(), F.struct(F.col(order).alias("at"), P.pose("x", "y", "rotation").alias("was"), P.pose("ax", "ay", "arotation").alias("now")))
    left, right = _beside([track, "visit"], order, mark)
    near = rows.withColumns({"l": left, "r": right}).where("ax IS NULL AND (l IS NOT NULL OR r IS NOT NULL)")
    l, r = F.coalesce("l", "r"), F.coalesce("r", "l")
    own = P.pose("x", "y", "rotation")
    share = F.when(l["at"] == r["at"], 0.0).otherwise((F.col(order) - l["at"]) / (r["at"] - l["at"]))
    moved = near.select(track, order, P.corrected(own, l["was"], l["now"]).alias("a"), P.corrected(own, r["was"], r["now"]).alias("b"), share.alias("s"))
    mix = lambda c: F.col(f"a.{c}") + F.col("s") * (F.col(f"b.{c}") - F.col(f"a.{c}"))
    turn = P.wrap(F.col("a.rotation") + F.col("s") * P.wrap(F.col("b.rotation") - F.col("a.rotation")))
    return moved.select(track, order, mix("x").alias("x"), mix("y").alias("y"), turn.alias("rotation"))


def evenly_spaced(df: DataFrame, track: str, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows per track at even steps, first and last included; of one, the last."""
    by = Window.partitionBy(track)
    rows = df.withColumn("i", F.row_number().over(by.orderBy(order)) - 1).withColumn("n", F.count("*").over(by))
    if limit == 1:
        return rows.where("i = n - 1").drop("i", "n")
    # Row i is taken if it is the rounded place of some k in 0..limit - 1.
    k = F.floor((F.col("i") + 0.5) * (limit - 1) / F.greatest(F.col("n") - 1, F.lit(1)) - 1e-12)
    hit = lambda j: half_up(j * (F.col("n") - 1) / F.lit(float(limit - 1))) == F.col("i")
    return rows.where((F.col("n") <= limit) | hit(k) | hit(k + 1)).drop("i", "n")


def midpoints(df: DataFrame, track: str, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows per track, each from the middle of an equal part."""
    by = Window.partitionBy(track)
    rows = df.withColumn("i", F.row_number().over(by.orderBy(order)) - 1).withColumn("n", F.count("*").over(by))
    k = F.floor(F.col("i") * limit / F.col("n").cast("double"))
    hit = lambda j: (F.floor((j + 0.5) * F.col("n") / limit) == F.col("i")) & (j >= 0) & (j < limit)
    return rows.where((F.col("n") <= limit) | hit(k) | hit(k - 1) | hit(k + 1)).drop("i", "n")


def strata(df: DataFrame, track: str, order: str, parts: int, score: str) -> DataFrame:
    """Rows with their ``part`` of equal length and their ``rank`` in it by falling score, unknown last."""
    by = Window.partitionBy(track)
    rows = df.withColumn("i", F.row_number().over(by.orderBy(order)) - 1).withColumn("n", F.count("*").over(by))
    parted = rows.withColumn("part", F.floor(F.col("i") * parts / F.col("n").cast("double")))
    best = Window.partitionBy(track, "part").orderBy(F.col(score).desc_nulls_last(), order)
    return parted.withColumn("rank", F.row_number().over(best)).drop("i", "n")


def frontier(samples: DataFrame, track: str, order: str, index: str) -> DataFrame:
    """The highest decode index needed up to each sample in order of presentation."""
    by = Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("frontier", F.max(index).over(by))


def frame_rates(samples: DataFrame, track: str, time: str) -> DataFrame:
    """Per track: mean rate, and whether steps stray from the mean by more than 100 µs and 2 %."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(track).orderBy(time))
    steps = samples.select(track, step.alias("step")).where("step IS NOT NULL")
    stats = steps.groupBy(track).agg(F.avg("step").alias("mean"), F.min("step").alias("low"), F.max("step").alias("high"))
    away = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    return stats.select(track, (1e6 / F.nullif(F.col("mean"), F.lit(0.0))).alias("fps"), (away > F.greatest(F.lit(100.0), 0.02 * F.col("mean"))).alias("variable"))


def closest_in_time(asks: DataFrame, samples: DataFrame, track: str, time: str, value: str) -> DataFrame:
    """For each ask the value of the sample nearest in time, of two equally near ones the later.

    ``asks`` has ``track``, ``time`` and ``ask``. Both sides are ranked in one window, without a range join.
    """
    rows = asks.select(track, time, "ask", F.lit(None).cast(samples.schema[value].dataType).alias(value)).unionByName(samples.select(track, time, F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"), value))
    mark = F.when(F.col(value).isNotNull(), F.struct(time, value))
    by, known = Window.partitionBy(track), F.last(mark, ignorenulls=True)
    left = known.over(by.orderBy(time, F.col(value).isNull()).rowsBetween(Window.unboundedPreceding, 0))
    right = known.over(by.orderBy(F.desc(time), F.col(value).isNull()).rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumns({"l": left, "r": right}).where("ask IS NOT NULL")
    use_left = F.col("r").isNull() | (F.col(time) - F.col(f"l.{time}") < F.col(f"r.{time}") - F.col(time))
    return near.select("ask", F.when(use_left, F.col(f"l.{value}")).otherwise(F.col(f"r.{value}")).alias(value))
