"""Scalar rules for pixels, colours and tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.stats import half_up


def to_linear(v: Column) -> Column:
    """The light of an encoded channel value in 0..1."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


def to_encoded(v: Column) -> Column:
    """The encoded value in 0..1 of a channel's light."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), 1 / 2.4) - 0.055)


def with_gain(value: Column, gain: Column, alpha: Column) -> Column:
    """An 8-bit channel with its light multiplied; transparent pixels stay."""
    lit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), to_linear(value / 255) * gain))
    return F.when(alpha == 0, value).otherwise(half_up(to_encoded(lit) * 255))


def refit_gray(r: Column, g: Column, b: Column, weights: tuple[float, float, float], contrast: float, brightness: float, gamma: float) -> Column:
    """Weighted luma after contrast, brightness and gamma, in 0..255."""
    luma = (weights[0] * r + weights[1] * g + weights[2] * b) / 255
    shaped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (luma - 0.5) * contrast + 0.5 + brightness))
    return 255 * F.pow(shaped, 1 / gamma)


def integer_luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000)


def edge_weight(x: Column, y: Column, width: int, height: int, share: float = 0.1) -> Column:
    """The smooth step from the frame's edge inwards that a blend weighs a pixel by."""
    depth = min(width * max(0.0, share), max(0.0, (min(width, height) - 1) / 2))
    if not depth > 0:
        return F.lit(1.0)
    nearest = F.least(x + 0.5, width - x - 0.5, y + 0.5, height - y - 0.5)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), nearest / depth))
    return t * t * (3 - 2 * t)


def support_colour(frame: Column) -> Column:
    """A hue by the golden angle."""
    return F.concat(F.lit("hsl("), F.round((frame * 137.508) % 360, 3).cast("string"), F.lit(" 70% 38%)"))


def coverage_cells(width: Column, height: Column) -> tuple[Column, Column]:
    """Columns and rows of the coverage grid: of 24 px, at least 24 by 18, at most 160."""
    return (
        F.least(F.lit(160), F.greatest(F.lit(24), F.ceil(width / 24))),
        F.least(F.lit(160), F.greatest(F.lit(18), F.ceil(height / 24))),
    )


def pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def cell_id(*coordinates: Column) -> Column:
    """Coordinates in steps of 8 px."""
    return F.concat_ws(":", *[half_up(c / 8).cast("string") for c in coordinates])


def stiffness(score: Column, support: Column, area: Column, cells: Column, residual: Column, cycle: Column) -> Column:
    """The weight 1..256 of a pair from independent evidence; null residual or cycle count as poor."""
    one, zero = F.lit(1.0), F.lit(0.0)
    correlation = F.greatest(zero, F.least(one, (score - 0.9) / 0.1))
    held = F.greatest(zero, F.least(support, F.coalesce(area, support)))
    size = F.least(F.lit(16.0), F.sqrt(held / 128))
    spread = F.least(F.lit(4.0), F.sqrt(cells / 3))
    apart = F.greatest(zero, F.coalesce(residual, F.lit(8.0)))
    around = F.greatest(zero, F.coalesce(cycle, F.lit(20.0)))
    agreement = 1 / (1 + F.pow(apart / 4, 2) + F.pow(around / 10, 2))
    return F.greatest(one, F.least(F.lit(256.0), 4 + 12 * correlation * size * spread * agreement))


def field_colour(dx: Column, dy: Column, reach: Column | float) -> Column:
    """A signed shift as red and blue, 0 as the middle."""
    part = lambda v: half_up(127.5 * (1 + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / reach))))
    return F.array(part(dx), F.lit(0).cast("long"), part(dy))


def deviation_colour(deviation: Column) -> Column:
    """From green at 0 to red at 1."""
    hue = F.round(120 * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), deviation))), 3)
    return F.concat(F.lit("hsl("), hue.cast("string"), F.lit(" 75% 45%)"))


#: Fixed weights of the channels where none are given.
LUMA = (0.299, 0.587, 0.114)


def refit_parameters(brightness: Column, contrast: Column, gamma: Column, red: Column, green: Column, blue: Column) -> Column:
    """Parameters within their bounds, missing ones at their defaults, and channel weights that sum to 1."""
    clamp = lambda v, low, high: F.least(F.lit(high), F.greatest(F.lit(low), v))
    usable = lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    weights = [clamp(usable(F.coalesce(v, F.lit(d))), 0.0, 4.0) for v, d in zip((red, green, blue), LUMA, strict=True)]
    whole = weights[0] + weights[1] + weights[2]
    share = [w / F.when(whole == 0, 1.0).otherwise(whole) for w in weights]
    return F.struct(
        clamp(F.coalesce(brightness, F.lit(0.0)), -1.0, 1.0).alias("brightness"), clamp(F.coalesce(contrast, F.lit(1.0)), 0.1, 4.0).alias("contrast"),
        clamp(F.coalesce(gamma, F.lit(1.0)), 0.1, 4.0).alias("gamma"), *[s.alias(n) for s, n in zip(share, ("red", "green", "blue"), strict=True)],
    )


def gray_matrix(red: Column, green: Column, blue: Column) -> Column:
    """The colour matrix, row by row, that gives every channel the weighted gray and keeps alpha."""
    row = [red, green, blue, F.lit(0), F.lit(0)]
    return F.concat_ws(" ", *[c.cast("string") for c in row * 3], F.lit("0 0 0 1 0"))


def detection_size(width: Column, height: Column, edge: int = 3840) -> tuple[Column, Column]:
    """The size at which a picture is searched: its longer side at most ``edge``."""
    scale = F.least(F.lit(1.0), edge / F.greatest(width, height))
    return F.greatest(F.lit(1), half_up(width * scale)), F.greatest(F.lit(1), half_up(height * scale))


def overlay_tile_edge(width: Column, height: Column, texture: int = 8192, budget: int = 1536 << 20) -> Column:
    """The greatest power of two that the memory left by the maps allows, 4096 at most; null below 512."""
    left = budget - width * height * 17
    edge = F.least(F.lit(4096), F.lit(texture), F.floor(F.sqrt(left / 24)))
    return F.when((left > 0) & (edge >= 512), F.pow(F.lit(2), F.floor(F.log2(edge))).cast("long"))


def metric_scale(grid_mm: Column, step: Column) -> tuple[Column, Column]:
    """Millimetres per pixel and dots per inch; null without a positive grid width."""
    mm = F.when(grid_mm > 0, grid_mm)
    return mm / step, 25.4 * step / mm


def preview_gray(gain: Column, low: float = 0.6, high: float = 1.4) -> Column:
    """The relative transmission as a gray value."""
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 / gain - low) / (high - low))) * 255)


def bilinear(gray: Column, side: int, x: Column, y: Column) -> Column:
    """The value between the four pixels around a place of a square picture; null outside or next to a null pixel."""
    at = lambda i, j: F.get(gray, (j * side + i).cast("int"))
    i, j = F.floor(x), F.floor(y)
    u, v = x - i, y - j
    inside = (x >= 0) & (y >= 0) & (x < side - 1) & (y < side - 1)
    return F.when(inside, (1 - v) * ((1 - u) * at(i, j) + u * at(i + 1, j)) + v * ((1 - u) * at(i, j + 1) + u * at(i + 1, j + 1)))
