"""Which further pairs to measure, what to keep of a path, and verdicts on a calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import ranks


def bridge_chains(pairs: DataFrame, path: DataFrame, track: str, order: str) -> DataFrame:
    """For each failed pair (``reference``, ``current``) the chain of consecutive frames between its ends.

    A chain of at least two links; ``length`` is its number of links. The range between the ends is opened
    by blocks of the order column, so the join is on equal blocks.
    """
    width = 256
    low, high = F.floor(F.col("reference") / width), F.floor(F.col("current") / width)
    asks = pairs.select(track, "reference", "current", F.explode(F.sequence(low, high)).alias("block"))
    nodes = path.select(track, F.col(order).alias("frame"), F.floor(F.col(order) / width).alias("block"))
    inside = asks.join(nodes, [track, "block"]).where("frame BETWEEN reference AND current")
    chain = Window.partitionBy(track, "reference", "current").orderBy("frame")
    links = inside.withColumn("from", F.lag("frame").over(chain)).where("from IS NOT NULL")
    count = F.count("*").over(Window.partitionBy(track, "reference", "current"))
    return links.withColumn("length", count).where("length >= 2").select(track, "reference", "current", "from", F.col("frame").alias("to"), "length")


def skips(chain: DataFrame, key: Sequence[str], reference: str, current: str, failed: str) -> DataFrame:
    """Pairs that step over a failed link of a chain, with the link before it or after it."""
    by = Window.partitionBy(*key).orderBy(reference)
    rows = chain.select(*key, reference, current, failed, F.lag(reference).over(by).alias("before"), F.lead(current).over(by).alias("after")).where(F.col(failed))
    both = F.array(F.struct(F.col("before").alias("r"), F.col(current).alias("c")), F.struct(F.col(reference).alias("r"), F.col("after").alias("c")))
    return rows.select(*key, F.inline(both)).where("r IS NOT NULL AND c IS NOT NULL AND r < c").distinct().withColumnsRenamed({"r": reference, "c": current})


def visit_pairs(visits: DataFrame, track: str, order: str, score: str) -> DataFrame:
    """Pairs that tie a path together: within a visit each row to the one before and to the sharpest; between
    neighbouring visits, and each visit and the first, the two sharpest rows of both."""
    best = F.row_number().over(Window.partitionBy(track, "visit").orderBy(F.col(score).desc_nulls_last(), order))
    ranked = visits.select(track, "visit", F.col(order).alias("frame"), best.alias("k"))
    heads = ranked.where("k <= 2")
    anchor = heads.where("k = 1").select(track, "visit", F.col("frame").alias("other"))
    prev = F.lag("frame").over(Window.partitionBy(track, "visit").orderBy("frame"))
    within = ranked.join(anchor, [track, "visit"]).select(track, "frame", "other").unionAll(ranked.select(track, "frame", prev.alias("other")).where("other IS NOT NULL"))
    left = heads.select(track, F.col("visit").alias("v"), F.col("frame").alias("other"))
    right = heads.where("visit > 0").select(track, "frame", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("visit") - 1))).alias("v"))
    between = right.join(left, [track, "v"]).select(track, "frame", "other")
    a, b = F.least("frame", "other"), F.greatest("frame", "other")
    return within.unionAll(between).where("frame != other").select(track, a.alias("reference"), b.alias("current")).distinct()


def kept(path: DataFrame, keep: DataFrame, track: str, order: str, reference: str) -> DataFrame:
    """The rows of kept frames, a reference to a frame that is not kept becoming null."""
    frames = keep.select(track, order).distinct()
    known = frames.select(track, F.col(order).alias(reference), F.lit(True).alias("known"))
    rows = path.join(frames, [track, order], "left_semi").join(known, [track, reference], "left")
    return rows.withColumn(reference, F.when(F.col("known"), F.col(reference))).drop("known")


def quality(points: Column, frames: Column, valid_share: Column, p95: Column, limit: float = 0.5) -> Column:
    """'validated' where enough held-out points of enough frames agree, else 'provisional'."""
    good = (points >= 20) & (frames >= 2) & (valid_share >= 0.6) & (p95 <= limit)
    return F.when(F.coalesce(good, F.lit(False)), "validated").otherwise("provisional")


def role(elapsed: Column, duration: Column, validation_from: float, old: Column | None = None) -> Column:
    """The split of a frame by its time; a role that it has already is kept."""
    new = F.when(elapsed >= duration * validation_from, "validation").otherwise("train")
    return new if old is None else F.coalesce(old, new)


def display_range(values: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A symmetric range about the middle that holds the inner 96 % of values, 0.02 wide at least."""
    s = ranks.exact_ranks(values, key, value, {"a": ranks.lower(0.02), "b": ranks.lower(0.98)})
    half = F.greatest(F.lit(0.01), F.abs(F.col("a") - 1), F.abs(F.col("b") - 1))
    return s.select(*key, (1 - half).alias("low"), (1 + half).alias("high"))


def fitted_brightness(blocks: DataFrame, frame: str, rounds: int = 12, smooth: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """Exposure of every frame and shading of every block from block brightness, in logarithms.

    ``blocks`` has the frame, ``row``, ``col`` and a positive ``value``. Each round takes a frame's exposure as the
    median of what the shading leaves, then a block's shading as the mean of what the exposures leave, smoothed
    over its four neighbours and centred. Blocks of a field are few; frames are the large side.
    """
    from fieldloom.operators.images import smoothed
    from fieldloom.storage import Scratch

    scratch = Scratch(blocks.sparkSession, "brightness")
    logs = scratch.save(blocks.where("value > 0").select(frame, "row", "col", F.log("value").alias("v")), "logs")
    field = scratch.save(logs.select("row", "col").distinct().withColumn("value", F.lit(0.0)), "field0")
    for n in range(1, rounds + 1):
        left = logs.join(field, ["row", "col"])
        exposure = left.groupBy(frame).agg(F.median(F.col("v") - F.col("value")).alias("exposure"))
        shade = logs.join(exposure, frame).groupBy("row", "col").agg(F.avg(F.col("v") - F.col("exposure")).alias("value")).withColumn("f", F.lit(0))
        even = smoothed(shade, ["f"], smooth)
        centre = even.agg(F.avg("value").alias("m"))
        field = scratch.save(even.crossJoin(F.broadcast(centre)).select("row", "col", (F.col("value") - F.col("m")).alias("value")), f"field{n}")
        scratch.drop(f"field{n - 1}")
    exposure = logs.join(field, ["row", "col"]).groupBy(frame).agg(F.median(F.col("v") - F.col("value")).alias("exposure"))
    return exposure, field
