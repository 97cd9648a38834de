"""Exact order statistics of groups of any size, without a list or a sort of a whole group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.storage import Scratch

#: Bins of a factor e of the values.
BINS = 4096


def rising_bin(v: Column) -> Column:
    """A whole number that rises with the value, by its logarithm."""
    size = F.floor(F.log(F.abs(v)) * BINS) + (1 << 40)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def exact_ranks(df: DataFrame, key: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(*key, ``n``, *ranks): of the values of each key their number, and those at the places (from 0) that ``ranks`` gives by their number.

    Values are counted by bins with map-side aggregation, which shows the bin of each place; only values in such bins are
    counted again one by one. Nulls and NaN are left out; a key without a value has no row.
    """
    k = list(key)
    rows = Scratch(df.sparkSession, "ranks").save(df.select(*k, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").withColumn("bin", rising_bin(F.col("v"))), "rows")
    by = Window.partitionBy(*k)
    bins = rows.groupBy(*k, "bin").agg(F.count("*").alias("held")).withColumns({
        "n": F.sum("held").over(by), "upto": F.sum("held").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
    })
    asked = F.array(*[F.struct(F.lit(name).alias("rank"), place(F.col("n")).cast("long").alias("place")) for name, place in ranks.items()])
    wanted = bins.select(*k, "bin", "n", "held", "upto", F.inline(asked)).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("held")))
    targets = wanted.select(*k, "bin", "n", "rank", (F.col("place") - F.col("upto") + F.col("held")).alias("within"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*k, "bin"]]
    few = rows.alias("r").join(targets.select(*k, "bin").distinct().alias("t"), same, "left_semi").groupBy(*k, "bin", "v").agg(F.count("*").alias("held"))
    placed = few.withColumn("upto", F.sum("held").over(Window.partitionBy(*k, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = (F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("held"))
    found = placed.alias("r").join(targets.alias("t"), same).where(hit).select(*[F.col(f"t.{c}").alias(c) for c in k], "n", "rank", "v")
    return found.groupBy(*k).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("rank") == name, F.col("v"))).alias(name) for name in ranks])


def upper(share: float) -> Callable[[Column], Column]:
    """Place min(n - 1, floor(share n))."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(share)))


def nearest(share: float) -> Callable[[Column], Column]:
    """The place nearest to the share of the way."""
    return lambda n: F.floor((n - 1) * F.lit(share) + 0.5)


def lower(share: float) -> Callable[[Column], Column]:
    """Place floor(share (n - 1))."""
    return lambda n: F.floor((n - 1) * F.lit(share))
