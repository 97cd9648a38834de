"""A subset of given size that covers the variety of the rows, by density from hash buckets.

Feature vectors are hashed repeatedly with a locality-sensitive hash (random projections cut into
steps). The mean size of a row's buckets estimates how many rows lie near it, and a fixed-size weighted
sample is drawn with probability inverse to that density.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from fieldloom.llm.overlap import usable_points
from fieldloom.storage import Scratch

#: A bucket is hot if it holds more than this part of all bucket entries; so at most as many are hot.
HOT_PARTS = 2000
#: Keys that are sorted at a time where the sample ends.
CUT = 1 << 16


def view_features(points: str = "points") -> Column:
    """Position and shape of a point set in pixels, whatever its order: centre, spreads and lean."""
    pts = usable_points(f"`{points}`")
    sums = (
        f"aggregate({pts}, named_struct('n', 0D, 'x', 0D, 'y', 0D, 'xx', 0D, 'yy', 0D, 'xy', 0D), (s, p) -> "
        "named_struct('n', s.n + 1D, 'x', s.x + p.x, 'y', s.y + p.y, 'xx', s.xx + p.x * p.x, 'yy', s.yy + p.y * p.y, 'xy', s.xy + p.x * p.y), s -> "
        "array(s.x / s.n, s.y / s.n, "
        "sqrt(greatest(0D, s.xx / s.n - pow(s.x / s.n, 2))), sqrt(greatest(0D, s.yy / s.n - pow(s.y / s.n, 2))), "
        "signum(s.xy / s.n - s.x * s.y / (s.n * s.n)) * sqrt(abs(s.xy / s.n - s.x * s.y / (s.n * s.n)))))"
    )
    return F.expr(f"CASE WHEN size({pts}) > 0 THEN {sums} END")


def lsh_buckets(features: str, dims: int, tables: int, hashes: int, width: float, seed: int) -> Column:
    """An array with a bucket for each table."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((tables, hashes, dims)), rng.uniform(0, width, (tables, hashes))
    buckets = []
    for t in range(tables):
        cuts = []
        for h in range(hashes):
            total = " + ".join(f"{float(a[t, h, d])!r}D * `{features}`[{d}]" for d in range(dims))
            cuts.append(f"floor(({total} + {float(b[t, h])!r}D) / {width!r}D)")
        buckets.append(f"xxhash64({t}, {', '.join(cuts)})")
    return F.expr(f"array({', '.join(buckets)})")


def local_density(df: DataFrame, item: str, features: str, dims: int, tables: int = 10, hashes: int = 4, width: float = 60.0, seed: int = 7) -> DataFrame:
    """(``item``, ``density``): the mean number of rows in the item's buckets, itself included.

    ``item`` is unique and not null and ``features`` an array of ``dims`` finite doubles below 1e12; rows for which
    either fails are left out. Buckets are counted with map-side aggregation. Counts of hot buckets
    are broadcast, of which by their definition there are at most ``HOT_PARTS``; all others are joined
    by bucket, where no key can be hot.
    """
    scratch = Scratch(df.sparkSession, "density")
    ok = F.col(item).isNotNull() & (F.size(features) == dims) & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e12))
    entries = scratch.save(
        df.where(ok).select(F.col(item).alias("item"), F.explode(lsh_buckets(features, dims, tables, hashes, width, seed)).alias("bucket")), "entries"
    )
    counts = scratch.save(entries.groupBy("bucket").agg(F.count("*").alias("held")), "counts")
    total = counts.agg(F.sum("held")).first()[0] or 0
    hot = counts.where(F.col("held") > total / HOT_PARTS).withColumnRenamed("held", "hot")
    marked = entries.join(F.broadcast(hot), "bucket", "left")
    cold = marked.where("hot IS NULL").join(counts.where(F.col("held") <= total / HOT_PARTS), "bucket").select("item", "held")
    held = cold.unionAll(marked.where("hot IS NOT NULL").select("item", "hot"))
    return held.groupBy("item").agg((F.sum("held") / tables).alias("density")).withColumnRenamed("item", item)


def weighted_sample(df: DataFrame, item: str, weight: str, size: int, seed: int = 7) -> DataFrame:
    """``size`` rows drawn without replacement with probability by ``weight``; all rows if there are fewer.

    Each row gets the key -ln(u) / weight with u hashed from the item, and the smallest keys win. The
    cut is found from a histogram of the keys, whose last bin is cut again until it is small. Rows with a
    null item or without a positive finite weight are never drawn; the same input gives the same sample.
    """
    scratch = Scratch(df.sparkSession, "sample")
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(item)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    good = F.col(item).isNotNull() & (F.col(weight) > 0) & (F.col(weight) < F.lit(float("inf"))) & ~F.isnan(weight)
    keyed = scratch.save(
        df.where(good).withColumn("__key", -F.log(unit) / F.col(weight)).withColumn("__bin", F.floor(F.log("__key") * 64)), "keyed"
    )
    taken, within, need = [], keyed, size
    while True:
        cut = _cut(within, need)
        if cut is None:
            taken.append(within)
            break
        taken.append(within.where(F.col("__bin") < cut["__bin"]))
        within, need = within.where(F.col("__bin") == cut["__bin"]), need - (cut["__upto"] - cut["__n"])
        ends = within.agg(F.min("__key").alias("low"), F.max("__key").alias("high")).first()
        if cut["__n"] <= CUT or not ends["low"] < ends["high"]:
            taken.append(within.orderBy("__key", item).limit(need))
            break
        within = within.withColumn("__bin", F.floor((F.col("__key") - ends["low"]) / (ends["high"] - ends["low"]) * 1024))
    return reduce(DataFrame.unionByName, taken).drop("__key", "__bin")


def _cut(keyed: DataFrame, need: int) -> Row | None:
    """The bin in which the smallest ``need`` keys end; None if there are fewer."""
    bins = keyed.groupBy("__bin").agg(F.count("*").alias("__n"))  # a few hundred bins of a logarithm, or a thousand of a bin
    upto = bins.withColumn("__upto", F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where(F.col("__upto") >= need).orderBy("__bin").first()


def varied_subset(df: DataFrame, item: str, features: str, dims: int, size: int, width: float = 60.0, seed: int = 7) -> DataFrame:
    """``item``, ``density`` and ``weight`` of ``size`` rows, drawn with probability inverse to their density.

    The sample has ``size`` rows, or all usable ones if there are fewer; an empty table gives none.
    """
    density = local_density(df, item, features, dims, width=width, seed=seed).withColumn("weight", 1 / F.col("density"))
    return weighted_sample(density, item, "weight", size, seed)


def varied_frames(frames: DataFrame, size: int = 2000, least_points: int = 6) -> DataFrame:
    """A subset of the distinct enabled frames that covers the board positions and shapes seen.

    Frames with ``enabled`` null or false, a null id, or fewer than ``least_points`` points with a
    finite position take no part; copies of a frame count once.
    """
    usable = frames.where(F.col("enabled") & F.col("frame_id").isNotNull()).where(f"size({usable_points()}) >= {least_points}")
    once = usable.select("frame_id", view_features().alias("features")).dropDuplicates(["frame_id"])
    return varied_subset(once, "frame_id", "features", 5, size)
