"""Masks of square cells over a picture: painting, lookup of patches, remapping.

A mask is a table of ``mask_col``, ``mask_row`` and ``value`` (0 neutral, 1 search, 2 forbidden), one row for each cell of one
picture, so it is bounded by the picture's size and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G

NEUTRAL, SEARCH, FORBIDDEN = 0, 1, 2


@dataclass(frozen=True)
class Grid:
    """The size of the picture and of a cell in pixels."""

    width: int
    height: int
    cell: int = 0

    def __post_init__(self) -> None:
        if not self.cell:
            object.__setattr__(self, "cell", max(4, -(-max(self.width, self.height) // 512)))

    @property
    def columns(self) -> int:
        return -(-self.width // self.cell)

    @property
    def rows(self) -> int:
        return -(-self.height // self.cell)

    def at(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The cell of a place, those beyond the picture's edge belonging to the last cell inside."""
        inside = lambda v, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.floor(v / self.cell)))
        return inside(x, self.columns), inside(y, self.rows)

    def within(self, x: Column, y: Column) -> Column:
        return (x >= 0) & (y >= 0) & (x < self.width) & (y < self.height)


def empty(spark: SparkSession, grid: Grid, value: int = NEUTRAL) -> DataFrame:
    """All cells with one value."""
    cells = spark.range(grid.columns * grid.rows)
    return cells.select((F.col("id") % grid.columns).alias("mask_col"), F.floor(F.col("id") / grid.columns).alias("mask_row"), F.lit(value).alias("value"))


def _reach(df: DataFrame, grid: Grid, x: Column, y: Column, radius: Column) -> DataFrame:
    """Rows once for each cell that the square of the radius around a place meets; none where it meets no cell."""
    low = lambda v: F.greatest(F.lit(0).cast("long"), F.floor((v - radius) / grid.cell))
    high = lambda v, n: F.least(F.lit(n - 1).cast("long"), F.floor((v + radius) / grid.cell))
    ranged = df.withColumns({"c0": low(x), "c1": high(x, grid.columns), "r0": low(y), "r1": high(y, grid.rows)}).where("c0 <= c1 AND r0 <= r1")
    return ranged.withColumn("mask_col", F.explode(F.sequence("c0", "c1"))).withColumn("mask_row", F.explode(F.sequence("r0", "r1"))).drop("c0", "c1", "r0", "r1")


def touching(patches: DataFrame, mask: DataFrame, grid: Grid, key: Sequence[str], size: float, value: int) -> DataFrame:
    """The keys of patches (``x``, ``y``, ``size`` wide) that meet a cell of the value."""
    cells = mask.where(F.col("value") == value).select("mask_col", "mask_row")
    met = _reach(patches.select(*key, "x", "y"), grid, F.col("x"), F.col("y"), F.lit(size / 2))
    return met.join(F.broadcast(cells), ["mask_col", "mask_row"], "left_semi").select(*key).distinct()


def allowed(patches: DataFrame, mask: DataFrame, grid: Grid, key: Sequence[str], size: float, need_search: bool = False) -> DataFrame:
    """The patches that meet no forbidden cell and, if asked for, have their centre in a search cell."""
    free = patches.join(touching(patches, mask, grid, key, size, FORBIDDEN), list(key), "left_anti")
    if not need_search:
        return free
    col, row = grid.at(F.col("x"), F.col("y"))
    search = mask.where(F.col("value") == SEARCH).select("mask_col", "mask_row")
    return free.withColumns({"mask_col": col, "mask_row": row}).join(F.broadcast(search), ["mask_col", "mask_row"], "left_semi").drop("mask_col", "mask_row")


def painted(mask: DataFrame, strokes: DataFrame, grid: Grid) -> DataFrame:
    """The mask after circles (``step``, ``x``, ``y``, ``radius``, ``value``) are painted in the order of their steps."""
    met = _reach(strokes, grid, F.col("x"), F.col("y"), F.col("radius"))
    hit = met.where(G.circle_meets_cell(F.col("x"), F.col("y"), F.col("radius"), F.col("mask_col"), F.col("mask_row"), grid.cell))
    last = hit.groupBy("mask_col", "mask_row").agg(F.max_by("value", "step").alias("new"))
    return mask.join(last, ["mask_col", "mask_row"], "left").select("mask_col", "mask_row", F.coalesce("new", "value").alias("value"))


def around(views: DataFrame, grid: Grid, share: float = 0.4) -> DataFrame:
    """The search cells of a round selection in each view, by its local centre ``x``, ``y``; of a share of 1 the whole picture."""
    radius = min(grid.width, grid.height) * max(0.1, min(1.0, share)) / 2
    px = F.least(F.lit(float(grid.width - 1)), (F.col("mask_col") + 0.5) * grid.cell)
    py = F.least(F.lit(float(grid.height - 1)), (F.col("mask_row") + 0.5) * grid.cell)
    if share >= 1:
        return views.crossJoin(F.broadcast(empty(views.sparkSession, grid, SEARCH)))
    near = _reach(views, grid, F.col("x"), F.col("y"), F.lit(radius + grid.cell))
    return near.where((px - F.col("x")) * (px - F.col("x")) + (py - F.col("y")) * (py - F.col("y")) <= radius * radius).withColumn("value", F.lit(SEARCH))


def remapped(mask: DataFrame, grid: Grid, maps: DataFrame, out: Grid) -> DataFrame:
    """The search cells of a rectified picture: those whose centre stems from a search cell of the source.

    ``maps`` has a row for each output pixel: ``u``, ``v``, the source place ``x``, ``y`` and ``valid``.
    """
    centre = lambda n, size: F.least(F.lit(size - 1).cast("long"), F.floor((F.col(n) + 0.5) * out.cell))
    centres = empty(mask.sparkSession, out).select(F.col("mask_col").alias("out_col"), F.col("mask_row").alias("out_row"), centre("mask_col", out.width).alias("u"), centre("mask_row", out.height).alias("v"))
    placed = maps.where(F.col("valid") & grid.within(F.col("x"), F.col("y"))).join(F.broadcast(centres), ["u", "v"])
    col, row = grid.at(F.col("x"), F.col("y"))
    search = mask.where(F.col("value") == SEARCH).select("mask_col", "mask_row")
    found = placed.withColumns({"mask_col": col, "mask_row": row}).join(F.broadcast(search), ["mask_col", "mask_row"], "left_semi")
    return found.select(F.col("out_col").alias("mask_col"), F.col("out_row").alias("mask_row"))


def cropped(maps: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """The maps of a part of the output, its corner as the new origin."""
    inside = F.col("u").between(left, left + width - 1) & F.col("v").between(top, top + height - 1)
    return maps.where(inside).withColumns({"u": F.col("u") - left, "v": F.col("v") - top})


def remap(maps: DataFrame, pixels: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Output pixels between the four source pixels around their place.

    ``pixels`` has the key, ``px``, ``py``, the value and ``allowed``. A pixel of which a neighbour is absent or not
    allowed has no row. The four corners are joined by equality and summed.
    """
    i, j = F.floor("x"), F.floor("y")
    du, dv = F.col("x") - i, F.col("y") - j
    corners = F.array(*[
        F.struct((i + a).alias("px"), (j + b).alias("py"), ((du if a else 1 - du) * (dv if b else 1 - dv)).alias("w")) for a in (0, 1) for b in (0, 1)
    ])
    opened = maps.where("valid").select(*key, "u", "v", F.inline(corners))
    held = opened.join(pixels.where("allowed").select(*key, "px", "py", value), [*key, "px", "py"])
    return held.groupBy(*key, "u", "v").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col(value)).alias(value)).where("n = 4").drop("n")
