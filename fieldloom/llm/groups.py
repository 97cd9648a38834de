"""Connected groups from pairwise matches, by alternating large-star and small-star rewrites.

The edges are pairs ``(hi, lo)`` with ``hi > lo``. A large-star step gives every edge the smallest
neighbour of its lower end, a small-star step ties all lower neighbours of a node to the smallest of
them. Both keep the components and end in one star per component, around its smallest member.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.storage import Scratch


def link_groups(pairs: DataFrame, a: str, b: str, scope: Sequence[str] = (), max_rounds: int = 60) -> DataFrame:
    """One row (*scope, ``group``, ``member``) for every record tied to another one.

    ``a`` and ``b`` are integer identifiers and ``scope`` further integer columns within which they
    hold; records of different scope are never tied. ``group`` is the smallest member. Pairs with a
    null in any of these columns and pairs of a record with itself tie nothing, repeated and reversed
    pairs count once, further columns are ignored, and an empty table gives an empty table.

    The rounds join and aggregate by node until no edge changes; each is written to the shared folder. A
    large group never meets in one task: minima are aggregated map-side, and the join of a hub's edges can be
    split by the engine. Round tables are merged, never broadcast, whatever their size. ``max_rounds`` is a
    guard: reaching it is an error, never a result.
    """
    names = [f"s{i}" for i in range(len(scope))]
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = pairs.select(
        *[F.col(c).cast("long").alias(s) for c, s in zip(scope, names, strict=True)],
        F.greatest(x, y).alias("hi"),
        F.least(x, y).alias("lo"),
        (x != y).alias("real"),
    )
    scratch = Scratch(pairs.sparkSession, "groups")
    edges = scratch.save(edges.dropna().where("real").drop("real").distinct(), "edges0")
    for n in range(1, max_rounds + 1):
        edges = scratch.save(_small_star(_large_star(edges, names), names), f"edges{n}")
        scratch.drop(f"edges{n - 1}")
        if edges.where("moved").isEmpty():
            break
        edges = edges.drop("moved")
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    out = [F.col(s).alias(c) for s, c in zip(names, scope, strict=True)]
    members = edges.select(*out, F.col("lo").alias("group"), F.col("hi").alias("member"))
    heads = edges.select(*names, "lo").distinct().select(*out, F.col("lo").alias("group"), F.col("lo").alias("member"))
    return members.unionByName(heads)


def _large_star(edges: DataFrame, names: list[str]) -> DataFrame:
    """(hi, lo) becomes (hi, smallest of lo and its neighbours)."""
    # A smaller neighbour of lo is the lower end of an edge in which lo is the upper one.
    below = edges.groupBy(*names, F.col("hi").alias("lo")).agg(F.min("lo").alias("least"))
    joined = edges.join(below.hint("merge"), [*names, "lo"], "left")
    least = F.coalesce("least", "lo")
    return joined.select(*names, "hi", least.alias("lo"), (least != F.col("lo")).alias("moved"))


def _small_star(edges: DataFrame, names: list[str]) -> DataFrame:
    """All lower neighbours of a node, and the node itself, are tied to the smallest of them."""
    least = edges.groupBy(*names, "hi").agg(F.min("lo").alias("least"))
    joined = edges.join(least.hint("merge"), [*names, "hi"])
    stays = F.col("lo") == F.col("least")
    rewritten = joined.select(
        *names,
        F.when(stays, F.col("hi")).otherwise(F.col("lo")).alias("hi"),
        F.col("least").alias("lo"),
        (F.col("moved") | ~stays).alias("moved"),
    )
    return rewritten.groupBy(*names, "hi", "lo").agg(F.max("moved").alias("moved"))


def frame_groups(entries: DataFrame) -> DataFrame:
    """Groups of the frames of every video that accepted matches tie (``video_id, group_frame, frame``).

    The records are the distinct frames of ``entries``. Accepted matches tie their frame and the
    matched frame where both are records of the video; frames tied to none are in no row.
    """
    frames = entries.select("video_id", F.col("frame").alias("matched")).dropna()
    match = F.col("incremental_match")
    pairs = (
        entries.where(match["accepted"])
        .select("video_id", "frame", match["frame"].alias("matched"))
        .where("frame != matched")
        .join(frames, ["video_id", "matched"], "left_semi")
    )
    return link_groups(pairs, "frame", "matched", ["video_id"]).select(
        "video_id", F.col("group").alias("group_frame"), F.col("member").alias("frame")
    )
