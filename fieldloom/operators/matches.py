"""The match network as tables: pairs, their measured cells, tombstones, and the edges that matches add to a graph.

A pair is keyed by its frames, the smaller one as ``reference``; ``key`` lists the columns before these two, if any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import image
from fieldloom.functions import pose as P


def gpu_method(kind: Column, gap: Column, correction: Column, forward: Column, backward: Column, support: Column, cycle: Column, regions: Column,
               score: float = 0.9995, most_cycle: float = 1.0, most_correction: float = 32.0, least_support: int = 1024) -> Column:
    """By which evidence a temporal pair stands without a second method: near-duplicate, independent-regions, or null.

    ``forward`` and ``backward`` are scores, ``support`` the smaller support of both; ``regions`` an array of
    ``score``, ``support`` and ``distance``. Poses that are not finite make ``correction`` null.
    """
    sound = (kind == "temporal") & (gap > 0) & (gap <= 128) & P.finite(correction) & P.finite(forward) & P.finite(backward) & (F.coalesce(support, F.lit(0)) >= least_support)
    both = lambda least: (forward >= least) & (backward >= least)
    back = lambda most: P.finite(cycle) & (cycle <= most)
    good = lambda r: P.finite(r["score"]) & (r["score"] >= 0.99) & (r["support"] >= 512) & P.finite(r["distance"]) & (r["distance"] <= 6)
    near = (gap <= 16) & both(score) & back(most_cycle) & (correction <= most_correction)
    spread = both(0.99) & back(2.0) & (correction <= 64) & (F.size(regions) == 4) & F.forall(regions, good)
    return F.when(F.coalesce(sound & near, F.lit(False)), "near-duplicate").when(F.coalesce(sound & spread, F.lit(False)), "independent-regions")


def usable_locally(accepted: Column, conditional: Column, score: Column, p: Column) -> Column:
    """Whether a local match counts: accepted, or conditionally with a score of 0.93 and a finite pose."""
    return F.coalesce(accepted | (conditional & P.finite(score) & (score >= 0.93) & P.valid(p)), F.lit(False))


def bounded(found: Column, predicted: Column, most_degrees: Column | float, width: float, height: float) -> Column:
    """Whether a match lies within 1.05 diagonals and the angle of its prediction."""
    away = F.sqrt(F.pow(found["x"] - predicted["x"], 2) + F.pow(found["y"] - predicted["y"], 2))
    degrees = F.degrees(F.abs(P.wrap(found["rotation"] - predicted["rotation"])))
    return (away <= 1.05 * (width**2 + height**2) ** 0.5) & (degrees <= most_degrees)


def backend(first_ok: Column, second_ok: Column, difference: Column, first_ms: Column, second_ms: Column) -> Column:
    """``second`` where it accepts the same, differs by 0.1 px at most and is faster, else ``first``."""
    same = (first_ok == second_ok) & F.when(first_ok & second_ok, P.finite(difference) & (difference <= 0.1)).otherwise(True)
    return F.when(same & (second_ms < first_ms), "second").otherwise("first")


def oriented(matches: DataFrame) -> DataFrame:
    """Matches with the smaller frame as reference: the measurement inverted and the ends of all cells swapped where needed.

    A match has ``reference``, ``current``, ``measurement`` and ``cells`` of ``reference``, ``current`` (points), ``psr`` and
    ``support``. Cells get their id and a quality by psr: a twentieth, 0.2 to 1, and 1 where unknown. Cells with an unknown end go.
    """
    # A column of its own: within a lambda the names would mean the columns that are replaced below.
    matches, flip = matches.withColumn("__flip", F.col("reference") > F.col("current")), F.col("__flip")
    place = lambda p: P.finite(p["x"]) & P.finite(p["y"])
    known = F.filter("cells", lambda c: c.isNotNull() & place(c["reference"]) & place(c["current"]))

    def cell(c: Column) -> Column:
        a, b = F.when(flip, c["current"]).otherwise(c["reference"]), F.when(flip, c["reference"]).otherwise(c["current"])
        psr = F.when(P.finite(c["psr"]), c["psr"])
        quality = F.coalesce(F.greatest(F.lit(0.2), F.least(F.lit(1.0), psr / 20)), F.lit(1.0))
        return F.struct(image.cell_id(a["x"], a["y"], b["x"], b["y"]).alias("id"), a.alias("reference"), b.alias("current"), psr.alias("psr"), c["support"].alias("support"), quality.alias("quality"))

    return matches.withColumns({
        "cells": F.transform(known, cell), "measurement": F.when(flip, P.invert(F.col("measurement"))).otherwise(F.col("measurement")),
        "reference": F.least("reference", "current"), "current": F.greatest("reference", "current"),
    }).drop("__flip")


def normalised(pairs: DataFrame) -> DataFrame:
    """Pairs between two different frames of 0 or more, with a finite measurement and a positive weight; cells without an unknown end, of quality 0.05 to 1."""
    good = (F.col("reference") >= 0) & (F.col("current") >= 0) & (F.col("reference") != F.col("current")) & P.valid(F.col("measurement")) & P.finite(F.col("weight")) & (F.col("weight") > 0)
    place = lambda p: P.finite(p["x"]) & P.finite(p["y"])
    cells = F.filter(F.coalesce("cells", F.array()), lambda c: c.isNotNull() & place(c["reference"]) & place(c["current"]))
    quality = lambda c: F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.when(P.finite(c["quality"]), c["quality"]).otherwise(1.0)))
    return pairs.where(F.coalesce(good, F.lit(False))).withColumn("cells", F.transform(cells, lambda c: c.withField("quality", quality(c))))


def merged(matches: DataFrame, deleted: DataFrame, key: Sequence[str], keep_strength: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pairs and the cells of a network after matches are put in, in the order of ``step``.

    ``matches`` are accepted and oriented; those that were in the network before come with the smallest steps. They
    have the key, ``step``, ``approximate``, ``weight``, ``measurement`` and ``cells``. A later match replaces the pair; an approximate one never
    replaces a precise one, and the first precise one drops the cells of approximate ones. Cells are replaced by id. So of a pair
    with any precise match only these count, else all; that needs no fold over the matches, only the last of each. ``keep_strength``
    keeps the greatest weight of those put in, approximate ones before the first precise one included. Deleted pairs stay out.
    """
    k = list(key)
    known = matches.join(deleted.select(*k), k, "left_anti")
    first = known.groupBy(*k).agg(F.min(F.when(~F.col("approximate"), F.col("step"))).alias("precise"))
    rows = known.join(first, k)
    counts = F.col("precise").isNull() | ~F.col("approximate")
    strength = F.max(F.when(counts | (F.col("step") < F.col("precise")), F.col("weight"))) if keep_strength else F.max_by("weight", F.when(counts, F.col("step")))
    pairs = rows.groupBy(*k).agg(
        F.max_by(F.struct("measurement", "approximate", "step"), F.when(counts, F.col("step"))).alias("l"), strength.alias("weight"), F.count(F.when(counts, 1)).alias("updates")
    ).select(*k, "l.measurement", "l.approximate", F.col("l.step").alias("step"), "weight", "updates")
    each = rows.where(counts).select(*k, "step", F.explode("cells").alias("cell"))
    cells = each.groupBy(*k, F.col("cell.id").alias("id")).agg(F.max_by("cell", "step").alias("cell"), F.min("step").alias("since")).select(*k, "id", "cell", "since")
    return pairs, cells


def revalued(cells: DataFrame, evidence: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells with the confidence, 0.05 to 1, of the last check (``id``, ``step``, ``confidence``) made since they are known; 1 without."""
    k = [*key, "id"]
    last = cells.join(evidence, k).where(F.col("step") > F.col("since")).groupBy(*k).agg(F.max_by("confidence", "step").alias("c"))
    clamped = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("c")))
    return cells.join(last, k, "left").withColumn("confidence", F.coalesce(clamped, F.lit(1.0))).drop("c")


def deleted_cells(cells: DataFrame, chosen: DataFrame, key: Sequence[str], cell_size: float = 32.0) -> tuple[DataFrame, DataFrame]:
    """The cells left after some (by ``id``) are deleted, and a tombstone for each: its ends and a radius of half a cell, 8 at least."""
    k = [*key, "id"]
    gone = cells.join(chosen.select(*k).distinct(), k, "left_semi")
    tombs = gone.select(*key, F.col("cell.reference").alias("reference_point"), F.col("cell.current").alias("current_point"), F.lit(max(8.0, cell_size / 2)).alias("radius"))
    return cells.join(chosen.select(*k), k, "left_anti"), tombs


def migrated(pairs: DataFrame, constraints: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pairs, and as pairs without cells the stored constraints (``reference``, ``current``, ``measurement``, ``weight``) of pairs not among them."""
    k, flip = list(key), F.col("reference") > F.col("current")
    turned = constraints.where(P.valid(F.col("measurement"))).withColumns({
        "measurement": F.when(flip, P.invert(F.col("measurement"))).otherwise(F.col("measurement")), "reference": F.least("reference", "current"), "current": F.greatest("reference", "current"),
    })
    first = turned.groupBy(*k).agg(F.min_by(F.struct("measurement", "weight"), "step").alias("l"))
    more = first.join(pairs.select(*k), k, "left_anti").select(*k, "l.measurement", "l.weight", F.lit(False).alias("has_cells"))
    return pairs.select(*k, "measurement", "weight", F.lit(True).alias("has_cells")).unionByName(more)


def projected(cells: DataFrame, poses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Both ends of every cell in the world, under the poses of their frames."""
    at = lambda end: poses.select(*scope, F.col("frame").alias(end), P.pose("x", "y", "rotation").alias(f"{end}_pose"))
    both = cells.join(at("reference"), [*scope, "reference"]).join(at("current"), [*scope, "current"])
    rx, ry = P.to_world(F.col("reference_pose"), F.col("cell.reference.x"), F.col("cell.reference.y"))
    cx, cy = P.to_world(F.col("current_pose"), F.col("cell.current.x"), F.col("cell.current.y"))
    return both.select(*scope, "reference", "current", "id", rx.alias("rx"), ry.alias("ry"), cx.alias("cx"), cy.alias("cy"))


def graph_edges(matches: DataFrame, nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Edges of a pose graph from matches between nodes, weighed by kind: incremental 1, spatial 8 if strict and 4 if not.

    ``matches`` has ``reference``, ``current``, ``spatial``, ``accepted``, ``confirmed`` (an inlier of a confirmed closure that also holds backwards),
    ``cycle`` (null if unknown), the pose found and ``reference_pose``.
    """
    cycle = F.col("cycle")
    tight = lambda most: F.coalesce(~P.finite(cycle), F.lit(True)) | (cycle <= most)
    strict = F.col("accepted") & tight(1.5)
    kind = F.when(~F.col("spatial"), F.when(F.col("accepted"), "incremental")).when(strict, "spatial-strict").when(F.col("accepted") | F.col("confirmed"), "spatial-conditional")
    weight = F.when(F.col("kind") == "incremental", 1).when(F.col("kind") == "spatial-strict", 8).otherwise(4)
    known = matches.withColumn("kind", kind).where("kind IS NOT NULL")
    for end in ("reference", "current"):
        known = known.join(nodes.select(*scope, F.col("frame").alias(end)), [*scope, end], "left_semi")
    good = known.where(P.valid(F.col("pose")) & P.valid(F.col("reference_pose")))
    return good.select(*scope, "reference", "current", P.relative(F.col("pose"), F.col("reference_pose")).alias("m"), "kind", weight.alias("weight"))


def local_edges(matches: DataFrame, key: Sequence[str], limit: float = 7.5, lever: float = 1000.0) -> DataFrame:
    """The matches that groups of local measurements agree on, each pair once.

    ``matches`` has ``item``, ``reference``, ``current``, the correction ``x``, ``y``, ``rotation`` of the predicted pose, ``usable``, ``cycle``,
    ``strict`` and ``score``. Of the usable ones of a group with a cycle within the limit, the largest neighbourhood counts if it is more than half and has two
    frames at either end; otherwise the strict one of highest score. A group is one place measured a few times, so its neighbourhoods are small.
    """
    k = list(key)
    good = matches.where(F.col("usable") & P.finite(F.col("cycle")) & (F.col("cycle") <= limit))
    a = good.select(*k, F.col("item").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("rotation").alias("ar"))
    dx, dy, turn = F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), P.wrap(F.col("rotation") - F.col("ar")) * lever
    near = a.join(good, k).where(F.sqrt(dx * dx + dy * dy + turn * turn) <= limit)
    sets = near.groupBy(*k, "a").agg(F.count("*").alias("n"), F.count_distinct("current").alias("ends"), F.count_distinct("reference").alias("starts"))
    best = sets.withColumn("place", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("n"), "a"))).where("place = 1")
    size = good.groupBy(*k).agg(F.count("*").alias("members"))
    agreed = best.join(size, k).where("ends >= 2 AND starts >= 2 AND 2 * n > members").select(*k, "a")
    inliers = near.join(agreed, [*k, "a"], "left_semi").select(*k, "reference", "current", "item", F.lit("consensus").alias("by"))
    place = F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("score"), "item"))
    alone = good.where("strict").join(agreed.select(*k), k, "left_anti").withColumn("place", place).where("place = 1").select(*k, "reference", "current", "item", F.lit("strict").alias("by"))
    once = F.row_number().over(Window.partitionBy(*k[:-1], "reference", "current").orderBy(k[-1], "item"))
    return inliers.unionByName(alone).withColumn("place", once).where("place = 1").drop("place")
