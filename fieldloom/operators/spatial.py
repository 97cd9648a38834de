"""Frames as rotated rectangles on a plane: selection for a mosaic, overlaps, neighbours, tiles.

A frame has a pose at its centre and the same ``width`` and ``height`` as all others. Every join here is an
equi-join on grid cells with an exact test after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.storage import Scratch


@dataclass(frozen=True)
class Plane:
    """The size of all frames and the columns of their identifier and rank."""

    width: float = 400.0
    height: float = 300.0
    frame: str = "frame"
    score: str = "sharpness"

    def order(self) -> list[Column]:
        """Sharpest first, unknown last, then by frame."""
        return [F.col(self.score).desc_nulls_last(), F.col(self.frame).asc()]

    def key(self) -> Column:
        """The same order as one column, the sharpest smallest."""
        return F.struct(F.col(self.score).isNull().alias("unknown"), (-F.col(self.score)).alias("score"), F.col(self.frame).alias("frame"))

    def extent(self, df: DataFrame) -> DataFrame:
        """Frames with a pose, with the sine and cosine of it and the box around the frame."""
        c, s = F.cos("rotation"), F.sin("rotation")
        half_w, half_h = F.abs("c") * (self.width / 2) + F.abs("s") * (self.height / 2), F.abs("s") * (self.width / 2) + F.abs("c") * (self.height / 2)
        posed = df.where("x IS NOT NULL AND y IS NOT NULL AND rotation IS NOT NULL").withColumns({"c": c, "s": s})
        return posed.withColumns({"low_x": F.col("x") - half_w, "high_x": F.col("x") + half_w, "low_y": F.col("y") - half_h, "high_y": F.col("y") + half_h})

    def holds(self, px: Column, py: Column, prefix: str = "", slack: float = 0.0, closed: bool = False) -> Column:
        """Whether the point lies in the frame; ``slack`` grows the frame, ``closed`` counts its far edges."""
        col = lambda n: F.col(prefix + n)
        lx = col("c") * (px - col("x")) + col("s") * (py - col("y")) + self.width / 2
        ly = col("c") * (py - col("y")) - col("s") * (px - col("x")) + self.height / 2
        if closed:
            return (lx >= -slack) & (ly >= -slack) & (lx <= self.width + slack) & (ly <= self.height + slack)
        return (lx >= 0) & (ly >= 0) & (lx < self.width) & (ly < self.height)


def bounds(extent: DataFrame) -> DataFrame:
    """The whole box of all frames in whole pixels: one row."""
    return extent.agg(F.floor(F.min("low_x")).alias("min_x"), F.floor(F.min("low_y")).alias("min_y"), F.ceil(F.max("high_x")).alias("max_x"), F.ceil(F.max("high_y")).alias("max_y"))


def estimate(box: DataFrame, tile: int = 2048, pixel_bytes: int = 4) -> DataFrame:
    """Columns, rows and number of tiles, and bytes, of a mosaic of the box."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return box.select("min_x", "min_y", "max_x", "max_y", F.ceil(w / tile).alias("columns"), F.ceil(h / tile).alias("rows"), (F.ceil(w / tile) * F.ceil(h / tile)).alias("tiles"), (w * h * pixel_bytes).alias("bytes"))


def cover_cells(plane: Plane, frames: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """Every frame once for each grid cell that its box meets, with the cell's box clipped to the whole one."""
    extent = plane.extent(frames)
    placed = extent.crossJoin(F.broadcast(bounds(extent)))
    at = lambda c, o: F.floor((c - F.col(o)) / cell)
    last = lambda low, high: F.ceil((F.col(high) - F.col(low)) / cell) - 1
    ranged = placed.withColumns({
        "l": F.greatest(F.lit(0), at(F.col("low_x") - margin, "min_x")), "r": F.least(last("min_x", "max_x"), at(F.col("high_x") + margin, "min_x")),
        "t": F.greatest(F.lit(0), at(F.col("low_y") - margin, "min_y")), "b": F.least(last("min_y", "max_y"), at(F.col("high_y") + margin, "min_y")),
    })
    each = ranged.withColumn("cell_col", F.explode(F.sequence("l", "r"))).withColumn("cell_row", F.explode(F.sequence("t", "b")))
    return each.withColumns({
        "x0": F.col("min_x") + F.col("cell_col") * cell, "y0": F.col("min_y") + F.col("cell_row") * cell,
        "x1": F.least(F.col("max_x").cast("double"), F.col("min_x") + (F.col("cell_col") + 1) * cell), "y1": F.least(F.col("max_y").cast("double"), F.col("min_y") + (F.col("cell_row") + 1) * cell),
    }).drop("l", "r", "t", "b", "min_x", "min_y", "max_x", "max_y")


def _whole(plane: Plane) -> Column:
    corners = [plane.holds(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
    return corners[0] & corners[1] & corners[2] & corners[3]


def merge_frames(plane: Plane, frames: DataFrame, most: int, feather: float = 0.1, probes: int = 8) -> DataFrame:
    """The frames that a mosaic of the ``most`` sharpest ones per place needs.

    A frame is needed if at any probe it has at most ``most`` sharper ones. Cells are 64 px wide, or as wide as the
    feathered edge. Before they are opened into probes, a frame is dropped from a cell in which more than ``most`` sharper
    ones cover it whole: those after the last of the sharpest ``most`` + 1 that do. These are limited before they are
    moved, and the rest is a join, so a cell under very many frames is no single sort.
    """
    cells = cover_cells(plane, frames, max(64.0, plane.width * max(0.025, feather)), 1.0).withColumn("key", plane.key())
    rank = F.row_number().over(Window.partitionBy("cell_col", "cell_row").orderBy("key"))
    whole = cells.where(_whole(plane)).select("cell_col", "cell_row", "key").withColumn("rank", rank).where(F.col("rank") <= most + 1)
    last = whole.where(F.col("rank") == most + 1).select("cell_col", "cell_row", F.col("key").alias("last"))
    open_cells = cells.join(last, ["cell_col", "cell_row"], "left").where(F.col("last").isNull() | (F.col("key") <= F.col("last")))
    k = F.explode(F.sequence(F.lit(0), F.lit(probes * probes - 1)))
    opened = open_cells.select(plane.frame, plane.score, "x", "y", "c", "s", "cell_col", "cell_row", "x0", "y0", "x1", "y1", k.alias("probe"))
    px = F.col("x0") + (F.col("probe") % probes + 0.5) / probes * (F.col("x1") - F.col("x0"))
    py = F.col("y0") + (F.floor(F.col("probe") / probes) + 0.5) / probes * (F.col("y1") - F.col("y0"))
    rank = F.row_number().over(Window.partitionBy("cell_col", "cell_row", "probe").orderBy(*plane.order()))
    held = opened.where(plane.holds(px, py)).select(plane.frame, plane.score, "cell_col", "cell_row", "probe")
    return held.withColumn("rank", rank).where(F.col("rank") <= most + 1).select(plane.frame).distinct()


def top_frames(plane: Plane, frames: DataFrame, most: int, cell: float = 64.0) -> DataFrame:
    """The frames among the ``most`` sharpest at the centre of any cell."""
    cells = cover_cells(plane, frames, cell).where(plane.holds(F.col("x0") + cell / 2, F.col("y0") + cell / 2))
    rank = F.row_number().over(Window.partitionBy("cell_col", "cell_row").orderBy(*plane.order()))
    return cells.withColumn("rank", rank).where(F.col("rank") <= most).select(plane.frame).distinct()


def block_ranks(plane: Plane, frames: DataFrame, divisions: int = 5, least: int = 3) -> DataFrame:
    """Every met block with the number of its ``least`` sharpest frames that cover it whole, and their list."""
    size = float(max(1, int(min(plane.width, plane.height) / divisions)))
    cells = cover_cells(plane, frames, size)
    meets = (F.col("low_x") < F.col("x1")) & (F.col("high_x") > F.col("x0")) & (F.col("low_y") < F.col("y1")) & (F.col("high_y") > F.col("y0"))
    corners = [plane.holds(F.col(x), F.col(y), slack=1e-7, closed=True) for x in ("x0", "x1") for y in ("y0", "y1")]
    whole = corners[0] & corners[1] & corners[2] & corners[3]
    rank = F.row_number().over(Window.partitionBy("cell_col", "cell_row", "whole").orderBy(*plane.order()))
    ranked = cells.where(meets).select(plane.frame, plane.score, "cell_col", "cell_row", whole.alias("whole")).withColumn("rank", rank).where(F.col("rank") <= least)
    return ranked.groupBy("cell_col", "cell_row").agg(F.count(F.when(F.col("whole"), 1)).alias("covered"), F.array_sort(F.collect_list(F.when(F.col("whole"), F.col(plane.frame)))).alias("frames"))


def reduced_frames(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.explode("frames").alias("frame")).distinct()


def block_summary(blocks: DataFrame, least: int = 3) -> DataFrame:
    return blocks.agg(F.count("*").alias("blocks"), F.count(F.when(F.col("covered") < least, 1)).alias("short_blocks"), F.count(F.when(F.col("covered") == 0, 1)).alias("uncovered_blocks"))


def tiles(plane: Plane, frames: DataFrame, tile: int, margin: float = 1.0, most: int = 8) -> DataFrame:
    """Every tile of the mosaic that a frame's box meets: how many frames, the first, and the ``most`` sharpest in order."""
    cells = cover_cells(plane, frames, float(tile), margin)
    counts = cells.groupBy("cell_row", "cell_col").agg(F.count("*").alias("frames"), F.min(plane.frame).alias("first_frame"))
    rank = F.row_number().over(Window.partitionBy("cell_row", "cell_col").orderBy(*plane.order()))
    best = cells.select("cell_row", "cell_col", plane.frame, plane.score).withColumn("rank", rank).where(F.col("rank") <= most)
    held = best.groupBy("cell_row", "cell_col").agg(F.array_sort(F.collect_list(F.struct("rank", plane.frame))).alias("l"))
    return counts.join(held.select("cell_row", "cell_col", F.col(f"l.{plane.frame}").alias("sharpest")), ["cell_row", "cell_col"])


def tile_parts(tiles_: DataFrame, rows_per_part: int) -> DataFrame:
    """Whole tile rows gathered into parts."""
    part = F.floor(F.col("cell_row") / rows_per_part)
    return tiles_.groupBy(part.alias("part")).agg(F.count("*").alias("tiles"), F.min("cell_row").alias("first_row"), F.max("cell_row").alias("last_row"))


def apart(plane: Plane, a: str, b: str) -> Column:
    """Whether two rotated frames lie apart, by the axes of both; touching ones do."""
    col = lambda p, n: F.col(p + n)
    dx, dy = col(b, "x") - col(a, "x"), col(b, "y") - col(a, "y")
    cos = F.abs(col(a, "c") * col(b, "c") + col(a, "s") * col(b, "s"))
    sin = F.abs(col(a, "s") * col(b, "c") - col(a, "c") * col(b, "s"))
    w, h = plane.width / 2, plane.height / 2
    tests = []
    for p in (a, b):
        along, across = F.abs(dx * col(p, "c") + dy * col(p, "s")), F.abs(dy * col(p, "c") - dx * col(p, "s"))
        tests += [along >= w + w * cos + h * sin, across >= h + w * sin + h * cos]
    return tests[0] | tests[1] | tests[2] | tests[3]


def _previous(df: DataFrame, item: str, width: int = 4096) -> DataFrame:
    """Every item (a whole number) with the next smaller one of the table: within blocks, and over the ends of blocks."""
    placed = df.select(item, F.floor(F.col(item) / width).alias("block"))
    ends = placed.groupBy("block").agg(F.max(item).alias("end"))  # one row for each block of the order
    carried = ends.select("block", F.lag("end").over(Window.orderBy("block")).alias("carried"))
    inside = placed.withColumn("inside", F.lag(item).over(Window.partitionBy("block").orderBy(item)))
    return inside.join(carried, "block").select(item, F.coalesce("inside", "carried").alias("previous"))


def overlap_pairs(plane: Plane, frames: DataFrame, neighbours: int = 4, least_support: int = 4, recent: int = 31) -> DataFrame:
    """Pairs of overlapping frames with their support, the probes of the common box that both hold.

    Each frame gets the frame before it (temporal) and up to ``neighbours`` earlier ones by support
    (spatial). Of a grid cell only its first frame and the ``recent`` ones before a frame are considered.
    """
    extent = plane.extent(frames)
    size = max(plane.width, plane.height)
    one = extent.select(plane.frame, "x", "y", "c", "s", "low_x", "high_x", "low_y", "high_y")
    fields = [c for c in one.columns if c != plane.frame]
    at = lambda c: F.floor(F.col(c) / size)
    cells = one.select(plane.frame, F.explode(F.sequence(at("low_x"), at("high_x"))).alias("i"), "low_y", "high_y").select(plane.frame, "i", F.explode(F.sequence(at("low_y"), at("high_y"))).alias("j"))
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("i", "j").orderBy(plane.frame)))
    # The window rule as an equi-join: blocks of the rank, each frame meets its own and the one before.
    block = F.floor(F.col("rank") / (recent + 1))
    now = ranked.select(F.col(plane.frame).alias("b"), "i", "j", F.col("rank").alias("rb"), F.explode(F.array(block, block - 1)).alias("k"))
    old = ranked.select(F.col(plane.frame).alias("a"), "i", "j", F.col("rank").alias("ra"), block.alias("k"))
    near = now.join(old, ["i", "j", "k"]).where((F.col("ra") < F.col("rb")) & (F.col("rb") - F.col("ra") <= recent)).select("a", "b")
    first = ranked.where("rank = 1").select(F.col(plane.frame).alias("a"), "i", "j").join(ranked.where("rank > 1").select(F.col(plane.frame).alias("b"), "i", "j"), ["i", "j"]).select("a", "b")
    before = _previous(one, plane.frame).withColumnsRenamed({"previous": "a", plane.frame: "b"}).where("a IS NOT NULL").select("a", "b")
    chosen = near.unionAll(first).distinct().withColumn("kind", F.lit("spatial")).unionAll(before.withColumn("kind", F.lit("temporal")))
    side = lambda p: one.select(F.col(plane.frame).alias(p), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    both = chosen.join(side("a"), "a").join(side("b"), "b").where(~apart(plane, "a_", "b_"))
    boxed = both.withColumns({
        "bx0": F.greatest("a_low_x", "b_low_x"), "bx1": F.least("a_high_x", "b_high_x"), "by0": F.greatest("a_low_y", "b_low_y"), "by1": F.least("a_high_y", "b_high_y"),
    }).withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(255))))
    px = F.col("bx0") + (F.col("probe") % 16 + 0.5) * (F.col("bx1") - F.col("bx0")) / 16
    py = F.col("by0") + (F.floor(F.col("probe") / 16) + 0.5) * (F.col("by1") - F.col("by0")) / 16
    held = boxed.where(plane.holds(px, py, "a_") & plane.holds(px, py, "b_")).groupBy("a", "b", "kind").agg(F.count("*").alias("support")).where(F.col("support") >= least_support)
    temporal = held.where("kind = 'temporal'")
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("support"), "a"))
    spatial = held.where("kind = 'spatial'").withColumn("place", best).where(F.col("place") <= neighbours).drop("place").join(temporal.select("a", "b"), ["a", "b"], "left_anti")
    return temporal.unionByName(spatial).select(F.col("a").alias("reference"), F.col("b").alias("current"), "kind", "support")


def nearest(points: DataFrame, item: str, group: Sequence[str], k: int, reach: float, barred: DataFrame | None = None, levels: Sequence[float] = (1 / 64, 1 / 16, 1 / 4)) -> DataFrame:
    """The ``k`` nearest other items of each item of the same group nearer than ``reach``; ties by item.

    An item that has ``k`` others within a part of the reach needs no others, so dense places are settled on
    fine grids and only what is left asks on coarser ones, the last of which is exact for all. Of many items at one and the same
    place only the smallest can be among the nearest, so the others only ask. ``barred`` has pairs (``reference`` <
    ``current``) that do not count.
    """
    # Each level is written, so that it runs once and its shuffle files go before the next.
    scratch = Scratch(points.sparkSession, "nearest")
    at = scratch.save(points.select(*group, item, "x", "y").where("x IS NOT NULL AND y IS NOT NULL"), "points")
    if barred is not None:
        barred = scratch.save(barred.select(*group, "reference", "current"), "barred")
    spare = 0
    if barred is not None:
        ends = barred.select(*group, F.explode(F.array("reference", "current")).alias(item))
        spare = ends.groupBy(*group, item).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    first = F.row_number().over(Window.partitionBy(*group, "x", "y").orderBy(item))
    near = scratch.save(at.withColumn("first", first).where(F.col("first") <= k + 1 + spare).drop("first"), "near")
    asks, found = at, None
    for level, part in enumerate([*levels, 1.0]):
        here = scratch.save(_within(asks, near, item, group, k, reach * part, barred), f"level{level}")
        if part < 1.0:
            full = here.groupBy(*group, "ask").agg(F.count("*").alias("n")).where(F.col("n") == k).select(*group, F.col("ask").alias(item))
            asks = scratch.save(asks.join(full, [*group, item], "left_anti"), f"asks{level}")
            here = here.join(full.withColumnRenamed(item, "ask"), [*group, "ask"], "left_semi")
        found = here if found is None else found.unionByName(here)
    return found


def _within(asks: DataFrame, points: DataFrame, item: str, group: Sequence[str], k: int, reach: float, barred: DataFrame | None) -> DataFrame:
    # Cells are four reaches wide, so what is asked meets 2.25 of them at an average.
    cell = lambda c: F.floor(c / (4 * reach))
    met = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    placed = points.select(*group, item, "x", "y", cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j"))
    opened = asks.withColumn("i", met("x")).withColumn("j", met("y")).select(*group, F.col(item).alias("ask"), F.col("x").alias("ax"), F.col("y").alias("ay"), "i", "j")
    d = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    pairs = opened.join(placed, [*group, "i", "j"]).where((F.col("ask") != F.col(item)) & (d < reach * reach)).select(*group, "ask", item, d.alias("d"))
    if barred is not None:
        pairs = pairs.withColumns({"reference": F.least("ask", item), "current": F.greatest("ask", item)}).join(barred, [*group, "reference", "current"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*group, "ask").orderBy("d", item))
    return pairs.withColumn("place", rank).where(F.col("place") <= k).select(*group, "ask", F.col(item).alias("near"), "place", F.sqrt("d").alias("distance"))


def fine_pairs(points: DataFrame, known: DataFrame, barred: DataFrame, item: str, group: Sequence[str], k: int, reach: float) -> DataFrame:
    """The pairs to measure finely, each once: those of every item with its ``k`` nearest and with the strongest known partner within reach.

    ``known`` has ``reference`` < ``current`` and ``weight``; ``barred`` pairs do not count.
    """
    g = list(group)
    close = nearest(points, item, g, k, reach, barred).select(*g, F.least("ask", "near").alias("reference"), F.greatest("ask", "near").alias("current"))
    end = lambda c, p: points.select(*g, F.col(item).alias(c), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")).where(f"{p}x IS NOT NULL AND {p}y IS NOT NULL")
    held = known.join(barred, [*g, "reference", "current"], "left_anti").join(end("reference", "a"), [*g, "reference"]).join(end("current", "b"), [*g, "current"])
    d = (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay"))
    ends = held.withColumn("d", d).where(F.col("d") < reach * reach).select(*g, "reference", "current", "weight", "d", F.explode(F.array("reference", "current")).alias("ask"))
    other = F.col("reference") + F.col("current") - F.col("ask")
    strong = ends.withColumn("place", F.row_number().over(Window.partitionBy(*g, "ask").orderBy(F.desc("weight"), "d", other))).where("place = 1")
    return close.unionByName(strong.select(*g, "reference", "current")).distinct()


def mutual_nearest(left: DataFrame, right: DataFrame, group: Sequence[str], reach: float) -> DataFrame:
    """Pairs of points (``a``, ``b``) of a group, each the nearest of the other side within ``reach``; candidates come from a grid of the reach."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*[F.struct((cell("ax") + i).alias("i"), (cell("ay") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    both = left.select("*", F.inline(around)).join(right.withColumns({"i": cell("bx"), "j": cell("by")}), [*group, "i", "j"])
    d = (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay"))
    near = both.select(*group, "a", "b", d.alias("d")).where(F.col("d") <= reach * reach)
    of_a = F.row_number().over(Window.partitionBy(*group, "a").orderBy("d", "b"))
    of_b = F.row_number().over(Window.partitionBy(*group, "b").orderBy("d", "a"))
    return near.withColumns({"ka": of_a, "kb": of_b}).where("ka = 1 AND kb = 1").select(*group, "a", "b", F.sqrt("d").alias("distance"))
