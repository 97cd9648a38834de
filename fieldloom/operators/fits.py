"""Weighted least-squares motions and grids of frames, from sums of one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(u: Column, v: Column, x: Column, y: Column, w: Column) -> dict[str, Column]:
    s = lambda c: F.sum(w * c)
    return {
        "n": F.count("*"), "sw": F.sum(w), "su": s(u), "sv": s(v), "sx": s(x), "sy": s(y), "suu": s(u * u), "suv": s(u * v), "svv": s(v * v),
        "sux": s(u * x), "svx": s(v * x), "suy": s(u * y), "svy": s(v * y), "sxx": s(x * x), "syy": s(y * y),
    }


def moments(points: DataFrame, key: list[str], step: float = 1.0, weight: str = "w") -> DataFrame:
    """Per key: mean positions and central sums of grid places (``col``, ``row``) and positions (``x``, ``y``)."""
    u, v = F.col("col") * step, F.col("row") * step
    total = points.groupBy(*key).agg(*[c.alias(k) for k, c in _moments(u, v, F.col("x"), F.col("y"), F.col(weight)).items()]).where("sw > 0")
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / F.col("sw")
    return total.select(
        *key, "n", "sw", (F.col("su") / F.col("sw")).alias("mu"), (F.col("sv") / F.col("sw")).alias("mv"), (F.col("sx") / F.col("sw")).alias("mx"),
        (F.col("sy") / F.col("sw")).alias("my"), c("suu", "su", "su").alias("uu"), c("suv", "su", "sv").alias("uv"), c("svv", "sv", "sv").alias("vv"),
        c("sux", "su", "sx").alias("ux"), c("svx", "sv", "sx").alias("vx"), c("suy", "su", "sy").alias("uy"), c("svy", "sv", "sy").alias("vy"),
    )


def rigid_fit(points: DataFrame, key: list[str], step: float = 1.0) -> DataFrame:
    """The weighted rigid motion from grid to picture of each key, and the scale of the best similarity.

    Keys whose weights do not sum to more than zero have no row; a grid without spread has scale 1.
    """
    m = moments(points, key, step)
    dot, cross, spread = F.col("ux") + F.col("vy"), F.col("uy") - F.col("vx"), F.col("uu") + F.col("vv")
    fit = m.withColumn("theta", F.atan2(cross, dot)).withColumn("scale", F.when(spread > 1e-9, F.sqrt(dot * dot + cross * cross) / spread).otherwise(1.0))
    c, s = F.cos("theta"), F.sin("theta")
    return fit.withColumns({"tx": F.col("mx") - c * F.col("mu") + s * F.col("mv"), "ty": F.col("my") - s * F.col("mu") - c * F.col("mv")})


def residuals(points: DataFrame, key: list[str], step: float = 1.0) -> DataFrame:
    """Each point with its distance from the rigid and from the similarity fit of its key."""
    fit = rigid_fit(points, key, step).select(*key, "mu", "mv", "mx", "my", "theta", "scale")
    both = points.join(fit, key)
    qu, qv = F.col("col") * step - F.col("mu"), F.col("row") * step - F.col("mv")
    c, s = F.cos("theta"), F.sin("theta")

    def off(scale: Column) -> Column:
        dx = F.col("x") - F.col("mx") - scale * (c * qu - s * qv)
        dy = F.col("y") - F.col("my") - scale * (s * qu + c * qv)
        return F.sqrt(dx * dx + dy * dy)

    return both.withColumns({"rigid_error": off(F.lit(1.0)), "similarity_error": off(F.col("scale"))})


def affine_geometry(points: DataFrame, key: list[str], step: float = 1.0) -> DataFrame:
    """Scale and anisotropy of each key's affine fit; no row below 3 points, without spread, or mirrored."""
    m = moments(points, key, step).where("n >= 3").withColumn("det", F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")).where("det > 1e-12")
    det = F.nullif(F.col("det"), F.lit(0.0))
    solve = lambda p, q: ((F.col(p) * F.col("vv") - F.col(q) * F.col("uv")) / det, (F.col(q) * F.col("uu") - F.col(p) * F.col("uv")) / det)
    (a, b), (c, d) = solve("ux", "vx"), solve("uy", "vy")

    def singular(m: Column) -> Column:
        area = m["a"] * m["d"] - m["b"] * m["c"]
        return F.struct(area.alias("area"), (m["a"] * m["a"] + m["b"] * m["b"] + m["c"] * m["c"] + m["d"] * m["d"]).alias("total"))

    def shape(m: Column) -> Column:
        gap = F.sqrt(F.greatest(F.lit(0.0), m["total"] * m["total"] - 4 * m["area"] * m["area"]))
        small = F.sqrt(F.greatest(F.lit(0.0), (m["total"] - gap) / 2))
        return F.struct(F.sqrt(m["area"]).alias("scale"), (F.sqrt((m["total"] + gap) / 2) / F.nullif(small, F.lit(0.0))).alias("anisotropy"))

    # Bound step by step in lambdas, as nested projections would repeat every sub-expression.
    bound = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))), singular)
    fit = F.transform(F.filter(bound, lambda x: x["area"] > 0), shape)
    return m.select(*key, F.inline(fit))
