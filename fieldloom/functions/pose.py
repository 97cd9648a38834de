"""Rigid plane poses as columns: structs of ``x``, ``y`` and ``rotation`` in radians."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pose(x: Column | str, y: Column | str, rotation: Column | str) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"), as_col(rotation).cast("double").alias("rotation"))


def wrap(angle: Column) -> Column:
    """The angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid(p: Column) -> Column:
    return finite(p["x"]) & finite(p["y"]) & finite(p["rotation"])


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y


def compose(a: Column, b: Column) -> Column:
    """The motion ``b`` seen from ``a``, then ``a``."""
    x, y = rotated(b["x"], b["y"], a["rotation"])
    return pose(a["x"] + x, a["y"] + y, wrap(a["rotation"] + b["rotation"]))


def invert(p: Column) -> Column:
    x, y = rotated(-p["x"], -p["y"], -p["rotation"])
    return pose(x, y, wrap(-p["rotation"]))


def relative(current: Column, reference: Column) -> Column:
    """The current pose in the reference's frame."""
    x, y = rotated(current["x"] - reference["x"], current["y"] - reference["y"], -reference["rotation"])
    return pose(x, y, wrap(current["rotation"] - reference["rotation"]))


def _factors(angle: Column) -> tuple[Column, Column]:
    tiny, safe = F.abs(angle) < 1e-8, F.when(F.abs(angle) < 1e-8, F.lit(1.0)).otherwise(angle)
    a = F.when(tiny, 1 - angle * angle / 6).otherwise(F.sin(safe) / safe)
    b = F.when(tiny, angle / 2).otherwise((1 - F.cos(safe)) / safe)
    return a, b


def exponential(p: Column) -> Column:
    """The motion of a constant twist."""
    a, b = _factors(p["rotation"])
    return pose(a * p["x"] - b * p["y"], b * p["x"] + a * p["y"], p["rotation"])


def logarithm(p: Column) -> Column:
    """The twist of a motion."""
    angle = wrap(p["rotation"])
    a, b = _factors(angle)
    d = a * a + b * b
    return pose((a * p["x"] + b * p["y"]) / d, (a * p["y"] - b * p["x"]) / d, angle)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, so that nested motions do not multiply the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def interpolate(first: Column, second: Column, share: Column) -> Column:
    """The pose at ``share`` of the way from ``first`` to ``second``, on their common screw."""
    step = lambda name, value: lambda v: F.struct(v["a"].alias("a"), v["s"].alias("s"), value(v).alias(name))
    back = bound(F.struct(first.alias("a"), share.alias("s"), invert(first).alias("n"), second.alias("b")), step("q", lambda v: compose(v["n"], v["b"])))
    twist = bound(back, step("w", lambda v: logarithm(v["q"])))
    part = bound(twist, step("w", lambda v: pose(v["s"] * v["w"]["x"], v["s"] * v["w"]["y"], v["s"] * v["w"]["rotation"])))
    motion = bound(part, step("m", lambda v: exponential(v["w"])))
    return bound(motion, lambda v: compose(v["a"], v["m"]))


def corrected(p: Column, before: Column, after: Column) -> Column:
    """``p`` moved as rigidly as its anchor moved from ``before`` to ``after``."""
    lx, ly = rotated(p["x"] - before["x"], p["y"] - before["y"], -before["rotation"])
    wx, wy = rotated(lx, ly, after["rotation"])
    return pose(after["x"] + wx, after["y"] + wy, wrap(p["rotation"] + after["rotation"] - before["rotation"]))


def to_world(p: Column, x: Column, y: Column) -> tuple[Column, Column]:
    rx, ry = rotated(x, y, p["rotation"])
    return p["x"] + rx, p["y"] + ry


def to_local(p: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return rotated(x - p["x"], y - p["y"], -p["rotation"])
