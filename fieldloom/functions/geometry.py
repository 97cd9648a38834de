"""Plane geometry as columns: orientations, grid places, polygons, segments, search radii."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def orientation(a: Column, b: Column, c: Column, d: Column, width: Column, height: Column) -> Column:
    """The placed picture under a quarter turn or mirror given as a 2 by 2 matrix; null for any other matrix.

    The struct has the shift that brings the picture back to the origin, its new size, and whether it moved at all.
    """
    whole = (F.abs(a) + F.abs(b) == 1) & (F.abs(c) + F.abs(d) == 1) & (F.abs(a * d - b * c) == 1)
    xs, ys = [F.lit(0) * width, a * width, c * height, a * width + c * height], [F.lit(0) * width, b * width, d * height, b * width + d * height]
    out = F.struct(
        (-F.least(*xs)).alias("shift_x"), (-F.least(*ys)).alias("shift_y"), (F.greatest(*xs) - F.least(*xs)).alias("width"), (F.greatest(*ys) - F.least(*ys)).alias("height"),
        (~((a == 1) & (b == 0) & (c == 0) & (d == 1))).alias("moved"),
    )
    return F.when(whole, out)


def grid_place(col: Column, row: Column, tx: Column, ty: Column, theta: Column, step: Column) -> tuple[Column, Column]:
    """Where a grid point lies on the plane under a pose."""
    return step * (F.cos(theta) * col - F.sin(theta) * row) + tx, step * (F.sin(theta) * col + F.cos(theta) * row) + ty


def turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Twice the signed area of the triangle a, b, p."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def inside_convex(corners: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a convex polygon, an array of ``x`` and ``y``; on an edge's line that edge does not count."""
    n = F.size(corners)
    sides = F.transform(corners, lambda p, i: turn(p["x"], p["y"], F.get(corners, (i + 1) % n)["x"], F.get(corners, (i + 1) % n)["y"], x, y))
    signs = F.array_distinct(F.transform(F.filter(sides, lambda s: F.abs(s) >= 1e-7), F.signum))
    return F.size(signs) == 1


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments ab and cd properly cross; the points are structs of ``x`` and ``y``."""
    t = lambda p, q, r: turn(p["x"], p["y"], q["x"], q["y"], r["x"], r["y"])
    return (t(a, b, c) * t(a, b, d) < -1e-10) & (t(c, d, a) * t(c, d, b) < -1e-10)


def rectangle_distance(x: Column, y: Column, width: Column | float, height: Column | float) -> Column:
    """The distance of a point from the rectangle at the origin; 0 inside."""
    dx, dy = F.greatest(F.lit(0.0), -x, x - width), F.greatest(F.lit(0.0), -y, y - height)
    return F.sqrt(dx * dx + dy * dy)


def search_radii(initial: Column, width: Column, height: Column, spatial: Column, share: float = 0.8) -> Column:
    """The radii of a search: the first one, and for a spatial search its doublings up to a share of the diagonal."""
    most = F.greatest(initial, F.ceil(F.sqrt(width * width + height * height) * share))
    doublings = F.ceil(F.log2(most / initial) - 1e-12)
    more = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), doublings.cast("int"))), lambda k: F.least(most, initial * F.pow(F.lit(2.0), k)).cast("long"))
    return F.when(spatial, more).otherwise(F.array(initial.cast("long")))


def circle_meets_cell(x: Column, y: Column, radius: Column | float, col: Column, row: Column, size: Column | float) -> Column:
    """Whether a circle reaches into a square cell of a grid."""
    near = lambda at, cell: F.greatest(cell * size, F.least(at, (cell + 1) * size)) - at
    return near(x, col) * near(x, col) + near(y, row) * near(y, row) <= radius * radius
