"""Pictures in array columns: sharpness, correlation, pyramids, shifts, blending."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.kernels import images as kernels


def _stack(column: pa.ListArray, side: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, side, side)


def sharpness(df: DataFrame, key: str, gray: str, side: int) -> DataFrame:
    """Laplacian variance and contrast of square pictures; rows without a whole picture are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            variance, contrast = kernels.laplacian(_stack(b.column(1), side))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(variance), pa.array(contrast)], names=[key, "variance", "contrast"])

    return df.where(F.size(gray) == side * side).select(key, gray).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, variance double, contrast double")


def half_size(df: DataFrame, key: str, gray: str, side: int) -> DataFrame:
    """The next pyramid level of square pictures; -1 is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small = kernels.halved(_stack(b.column(1), side)).reshape(b.num_rows, -1).astype(np.int32)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * small.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(small.ravel()))], names=[key, gray])

    return df.where(F.size(gray) == side * side).select(key, gray).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, `{gray}` array<int>")


def shifts(pairs: DataFrame, key: str, side: int) -> DataFrame:
    """The shift between the pictures ``a`` and ``b`` of each pair, with the height of its peak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = kernels.phase_shift(_stack(b.column(1), side), _stack(b.column(2), side))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found)], names=[key, "dx", "dy", "psr"])

    whole = (F.size("a") == side * side) & (F.size("b") == side * side)
    return pairs.where(whole).select(key, "a", "b").mapInArrow(run, f"`{key}` {dict(pairs.dtypes)[key]}, dx double, dy double, psr double")


def correlation(pixels: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Correlation, gain and bias of paired values; none below 16 values or where one hardly varies."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = pixels.groupBy(*key).agg(F.count("*").alias("n"), F.corr(x, y).alias("score"), F.regr_slope(y, x).alias("gain"), F.regr_intercept(y, x).alias("bias"), F.least(F.var_pop(x), F.var_pop(y)).alias("least"))
    return m.where("n >= 16 AND least >= 4").select(*key, "n", "score", "gain", "bias")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def capped_blend(layers: DataFrame, key: list[str], order: str, most: float) -> DataFrame:
    """The mean of layered values by their opacity, of which each pixel takes the first ``most`` in order."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.sum("alpha").over(before), F.lit(0.0))
    taken = F.greatest(F.lit(0.0), F.least(F.col("alpha"), F.lit(most) - had))
    part = layers.withColumn("taken", taken).groupBy(*key).agg(F.sum(F.col("value") * F.col("taken")).alias("v"), F.sum("taken").alias("alpha"))
    return part.where("alpha > 0").select(*key, (F.col("v") / F.col("alpha")).alias("value"), "alpha")


def smoothed(cells: DataFrame, key: list[str], strength: float = 0.08) -> DataFrame:
    """Each cell of a grid moved towards the mean of its four neighbours that are there."""
    sides = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    near = cells.select(*key, "row", "col", "value", F.inline(sides)).select(*key, (F.col("row") + F.col("di")).alias("row"), (F.col("col") + F.col("dj")).alias("col"), F.col("value").alias("near"))
    mean = near.groupBy(*key, "row", "col").agg(F.avg("near").alias("near"))
    out = cells.join(mean, [*key, "row", "col"], "left")
    return out.select(*key, "row", "col", (F.col("value") + strength * (F.coalesce("near", "value") - F.col("value"))).alias("value"))
