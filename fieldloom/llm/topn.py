"""The N best items of every group, by salted ranking in two stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_score(score: str | Column) -> Column:
    """A finite, non-negative score, else null."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < F.lit(float("inf"))), c)


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a subgroup that one task ranks, if a single group holds all rows; subgroups of a group at least.
SUBGROUP, LEAST_SALTS = 1 << 20, 32


def salts_for(rows: int) -> int:
    """Subgroups of each group so that none is large even where one group holds all rows."""
    return max(LEAST_SALTS, -(-rows // SUBGROUP))


def top_n_per_group(
    df: DataFrame, group: Sequence[str], score: str, item: str, n: int, salts: int | None = None, rank: str | None = None, salt: str | None = None
) -> DataFrame:
    """The ``n`` rows of every group with the highest ``score``, ties by ``item`` rising.

    Each group is hashed by item into ``salts`` subgroups; the first stage ranks and keeps ``n`` rows
    of every subgroup, the second ranks the survivors, of which a group has at most ``n * salts``.
    So no task holds a whole group. A hot group only costs more first-stage tasks. Without ``salts`` their
    number follows from a count of the rows; ``salt`` names a column that has the subgroup already.

    Null or NaN scores rank last, as equal. Null group values form a group of their own. A null item
    ranks after all others of its score. Rows that are equal in score and item count one by one, in
    either order. Further columns are kept; ``rank`` names a column for the rank, which must be new.
    An empty table gives an empty table; ``n`` below 1 is an error.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    if rank and rank.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {rank} exists already")
    if salt is None:
        salt = _free(df, "__salt")
        salts = salts or salts_for(df.count())
        df = df.withColumn(salt, F.pmod(F.xxhash64(F.col(item)), F.lit(salts)))
    place = _free(df, "__place")
    s = F.col(score)
    if dict(df.dtypes)[score] in ("double", "float"):
        s = F.when(~F.isnan(s), s)
    order = [s.desc_nulls_last(), F.col(item).asc_nulls_last()]
    first = Window.partitionBy(*group, salt).orderBy(*order)
    second = Window.partitionBy(*group).orderBy(*order)
    kept = (
        df.withColumn(place, F.row_number().over(first))
        .where(F.col(place) <= n)
        .drop(salt)
        .withColumn(place, F.row_number().over(second))
        .where(F.col(place) <= n)
    )
    return kept.withColumnRenamed(place, rank) if rank else kept.drop(place)


def top_frames_per_cell(entries: DataFrame, n: int = 4, salts: int | None = None) -> DataFrame:
    """The ``n`` sharpest frames of every video and coverage cell.

    A frame counts once, with the largest finite, non-negative sharpness among its rows. Rows with a
    null cell, video or frame are in no group. Duplicates are folded and the first ranking is done in
    one exchange by group and salt; only the survivors are exchanged again.
    """
    group = ["video_id", "cell_col", "cell_row"]
    rows = (
        entries.select(*group, "frame", usable_score("sharpness").alias("sharpness"))
        .dropna(subset=[*group, "frame"])
        .withColumn("__salt", F.pmod(F.xxhash64("frame"), F.lit(salts or salts_for(entries.count()))))
        .repartition(*group, "__salt")
    )
    frames = rows.groupBy(*group, "__salt", "frame").agg(F.max("sharpness").alias("sharpness"))
    return top_n_per_group(frames, group, "sharpness", "frame", n, rank="place", salt="__salt")
