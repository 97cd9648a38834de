"""The uniform cubic spline field: weights, stencils and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basis(t: Column, order: int = 0) -> Column:
    """The four weights of a cubic spline at ``t`` in 0..1, or of its first or second derivative."""
    if order == 0:
        w = [F.pow(1 - t, 3) / 6, (3 * F.pow(t, 3) - 6 * t * t + 4) / 6, (-3 * F.pow(t, 3) + 3 * t * t + 3 * t + 1) / 6, F.pow(t, 3) / 6]
    elif order == 1:
        w = [-(1 - t) * (1 - t) / 2, (3 * t * t - 4 * t) / 2, (-3 * t * t + 2 * t + 1) / 2, t * t / 2]
    else:
        w = [1 - t, 3 * t - 2, 1 - 3 * t, t]
    return F.array(*w)


def stencil(points: DataFrame, x: str, y: str, spacing: float) -> DataFrame:
    """Each point sixteen times, with the index (``cx``, ``cy``) and ``weight`` of a coefficient.

    The coefficient grid starts one cell before the origin. ``weight_x`` and ``weight_y`` belong to the
    derivatives in pixels.
    """
    u, v = F.col(x) / spacing, F.col(y) / spacing
    placed = points.withColumns({"iu": F.floor(u), "iv": F.floor(v)}).withColumns({"tu": u - F.col("iu"), "tv": v - F.col("iv")})
    placed = placed.withColumns({
        "bu": basis(F.col("tu")), "bv": basis(F.col("tv")), "du": basis(F.col("tu"), 1), "dv": basis(F.col("tv"), 1)
    })
    cells = placed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumns({"i": F.col("cell") % 4, "j": F.floor(F.col("cell") / 4).cast("int")})
    at = lambda c, k: F.get(F.col(c), F.col(k))
    return cells.select(
        *points.columns, (F.col("iu") + F.col("i")).alias("cx"), (F.col("iv") + F.col("j")).alias("cy"), (at("bu", "i") * at("bv", "j")).alias("weight"),
        (at("du", "i") * at("bv", "j") / spacing).alias("weight_x"), (at("bu", "i") * at("dv", "j") / spacing).alias("weight_y"),
    )


def evaluate(points: DataFrame, coefficients: DataFrame, key: str, x: str, y: str, spacing: float) -> DataFrame:
    """The displacement and its Jacobian at each point; ``coefficients`` has cx, cy, dx and dy.

    The coefficients of a field number at most a few hundred, and the points are the large side.
    """
    rows = stencil(points.select(key, x, y), x, y, spacing).join(coefficients, ["cx", "cy"])
    total = lambda w, d: F.sum(F.col(w) * F.col(d))
    return rows.groupBy(key).agg(
        total("weight", "dx").alias("dx"), total("weight", "dy").alias("dy"), (1 + total("weight_x", "dx")).alias("xx"),
        total("weight_y", "dx").alias("xy"), total("weight_x", "dy").alias("yx"), (1 + total("weight_y", "dy")).alias("yy"),
    )


def affine_start(df: DataFrame, width: Column, height: Column, spacing: int, affine: Sequence[Column]) -> DataFrame:
    """Rows once for each control point (``col``, ``row``) of a picture, with the shift ``dx``, ``dy`` of an affine map (xx, xy, yx, yy, x, y) there."""
    count = lambda size: F.floor((size - 1) / spacing) + 3
    grid = df.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), count(width)))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), count(height))))
    px, py = (F.col("col") - 1) * spacing, (F.col("row") - 1) * spacing
    xx, xy, yx, yy, ox, oy = affine
    return grid.withColumns({"dx": (xx - 1) * px + xy * py + ox, "dy": yx * px + (yy - 1) * py + oy})
