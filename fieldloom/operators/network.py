"""Pairwise measurements as a network: acceptance, edges, tombstones, consensus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import pose as P
from fieldloom.functions import stats
from fieldloom.kernels import returns


def verdict(forward: Column, backward: Column, cycle: Column, score: Column, support: Column, pose_ok: Column, limit: float = 2.0, least_score: float = 0.9, least_support: float = 128.0) -> Column:
    """The first reason against a measured pair, or null: direction, cycle, correlation, support, pose."""
    no = lambda c: F.coalesce(~c, F.lit(True))
    return (
        F.when(no(forward) | no(backward), "direction").when(no(P.finite(cycle) & (cycle <= limit)), "cycle")
        .when(no(P.finite(score) & (score >= least_score)), "correlation").when(no(P.finite(support) & (support >= least_support)), "support").when(no(pose_ok), "pose")
    )


def cell_edges(pairs: DataFrame, cells: DataFrame, key: Sequence[str], cell_size: float = 32.0, least_cells: int = 3) -> DataFrame:
    """One edge per pair from its measured cells: the rigid motion from current to reference, by quality.

    Pairs of fewer than ``least_cells`` cells or of too narrow a spread have no edge. ``cells`` has ``rx``,
    ``ry``, ``cx``, ``cy``, ``quality`` and ``confidence``, a null confidence counts as 1.
    """
    w = F.col("quality") * F.coalesce("confidence", F.lit(1.0))
    s = lambda c: F.sum(w * c)
    rx, ry, cx, cy = (F.col(c) for c in ("rx", "ry", "cx", "cy"))
    m = cells.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum("quality").alias("quality"), s(rx).alias("srx"), s(ry).alias("sry"), s(cx).alias("scx"), s(cy).alias("scy"),
        s(cx * rx + cy * ry).alias("dot"), s(cx * ry - cy * rx).alias("cross"), s(rx * rx + ry * ry).alias("rr"),
    ).where((F.col("n") >= least_cells) & (F.col("w") > 0))
    mean = m.withColumns({c: F.col(f"s{c}") / F.col("w") for c in ("rx", "ry", "cx", "cy")})
    dot = F.col("dot") - F.col("w") * (F.col("cx") * F.col("rx") + F.col("cy") * F.col("ry"))
    cross = F.col("cross") - F.col("w") * (F.col("cx") * F.col("ry") - F.col("cy") * F.col("rx"))
    spread = F.col("rr") / F.col("w") - F.col("rx") * F.col("rx") - F.col("ry") * F.col("ry")
    fit = mean.where(spread >= cell_size * cell_size / 16).withColumn("rotation", F.atan2(cross, dot))
    c, sn = F.cos("rotation"), F.sin("rotation")
    strength = F.col("weight") * F.col("w") / F.greatest(F.lit(float(max(3, least_cells))), F.col("quality"))
    return fit.join(pairs.select(*key, "weight"), list(key)).select(
        *key, "n", (F.col("rx") - c * F.col("cx") + sn * F.col("cy")).alias("x"), (F.col("ry") - sn * F.col("cx") - c * F.col("cy")).alias("y"), "rotation", strength.alias("weight")
    )


def suppressed_cells(cells: DataFrame, tombs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells without those of which both ends lie within the radius of a deleted cell of the same pair."""
    t = tombs.select(*[F.col(k).alias(f"t_{k}") for k in key], F.col("rx").alias("trx"), F.col("ry").alias("try_"), F.col("cx").alias("tcx"), F.col("cy").alias("tcy"), "radius")
    near = lambda x, y, tx, ty: (F.col(x) - F.col(tx)) * (F.col(x) - F.col(tx)) + (F.col(y) - F.col(ty)) * (F.col(y) - F.col(ty)) <= F.col("radius") * F.col("radius")
    same = [F.col(k) == F.col(f"t_{k}") for k in key]
    return cells.join(t, [*same, near("rx", "ry", "trx", "try_"), near("cx", "cy", "tcx", "tcy")], "left_anti")


def applied(graph: DataFrame, network: DataFrame, deleted: DataFrame, nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Graph edges of pairs the network does not know, and the network's edges between nodes, less deleted pairs."""
    known = network.select(*key).unionByName(deleted.select(*key)).distinct()
    a, b = key[-2], key[-1]
    ends = lambda end: nodes.select(*[F.col(k) for k in key[:-2]], F.col("frame").alias(end))
    ours = network.join(deleted.select(*key), list(key), "left_anti")
    for end in (a, b):
        ours = ours.join(ends(end), [*key[:-2], end], "left_semi")
    return graph.join(known, list(key), "left_anti").withColumn("kind", F.lit("graph")).unionByName(ours.select(*graph.columns).withColumn("kind", F.lit("network")))


def consensus(votes: DataFrame, key: Sequence[str], item: str, tolerance: float, lever: float) -> DataFrame:
    """Per key the medians of the largest set of agreeing poses, if it has two or more and a strict majority.

    ``votes`` has ``x``, ``y``, ``rotation`` and an ``item`` that breaks ties. A key has few votes: as many as
    a frame has references.
    """
    a = votes.select(*key, F.col(item).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("rotation").alias("ar"))
    both = a.join(votes.select(*key, F.col(item).alias("b"), "x", "y", "rotation"), list(key))
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    near = both.where(F.sqrt(dx * dx + dy * dy) + F.abs(P.wrap(F.col("rotation") - F.col("ar"))) * lever <= tolerance)
    sets = near.groupBy(*key, "a").agg(
        F.count("*").alias("inliers"), *[stats.sorted_values(F.col(c)).alias(f"s_{c}") for c in ("x", "y")], stats.sorted_values(P.wrap(F.col("rotation") - F.col("ar"))).alias("s_r"), F.first("ar").alias("ar")
    )
    best = sets.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("inliers"), "a"))).where("k = 1")
    total = votes.groupBy(*key).agg(F.count("*").alias("votes"))
    pick = best.join(total, list(key)).where((F.col("inliers") >= 2) & (2 * F.col("inliers") > F.col("votes")))
    q = lambda c: stats.upper_quantile(F.col(c), 0.5)
    return pick.select(*key, "inliers", "votes", q("s_x").alias("x"), q("s_y").alias("y"), (F.col("ar") + q("s_r")).alias("rotation"))


def overlap_checks(path: DataFrame, track: str, order: str, reach: float) -> DataFrame:
    """Per region the closest pair of places that the path comes back to: nearer than ``reach`` after travelling twice as far.

    Each place keeps its closest later one, each region of half the reach its closest pair. The path is cut into
    tiles, each with the places within the reach around it, so that every row is moved once or a little more; a tile
    is in one task.
    """
    from fieldloom.operators.windows import travelled

    # A row at which the path has not moved has the same answer as the one before and is never the first of its place.
    still = F.lag("travelled").over(Window.partitionBy(track).orderBy(order)) == F.col("travelled")
    moving = travelled(path, track, order).withColumn("still", F.coalesce(still, F.lit(False))).where("NOT still AND y IS NOT NULL")
    edge = TILE * reach
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1.001 * reach) / edge), F.floor((F.col(c) + 1.001 * reach) / edge)))
    places = moving.select(track, F.col(order).alias("at"), "x", "y", "travelled").withColumn("ti", tiles("x")).withColumn("tj", tiles("y"))
    kinds = dict(path.dtypes)
    tiled = places.repartition(track, "ti", "tj").sortWithinPartitions(track, "ti", "tj")
    best = tiled.mapInArrow(lambda batches: _closest_pairs(batches, reach), f"`{track}` {kinds[track]}, reference {kinds[order]}, current {kinds[order]}, d double, ri long, rj long")
    region = F.row_number().over(Window.partitionBy(track, "ri", "rj").orderBy("d", "reference"))
    return best.withColumn("k", region).where("k = 1").select(track, "reference", "current", "d")


#: Reaches in the edge of a tile; rows of small tiles that are taken together.
TILE, TOGETHER = 16, 100_000


def _closest_pairs(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Of tiles (track, at, x, y, travelled, ti, tj; sorted) the closest of their places' pairs in each region."""
    for table in _whole_tiles(batches):
        track, at = table.column(0).combine_chunks(), table.column(1).combine_chunks()
        x, y, way, ti, tj = (table.column(i).to_numpy() for i in range(2, 7))
        group = np.cumsum(_starts(table)) - 1
        edge = TILE * reach
        own = (np.floor(x / edge) == ti) & (np.floor(y / edge) == tj)
        corner = ti * edge - 2 * reach, tj * edge - 2 * reach
        a, b, d = returns.closest_later(group, x, y, corner, way, at.to_numpy(), np.flatnonzero(own), reach, 2 * reach)
        ri, rj = (np.floor((c[a] + c[b]) / 2 / (reach / 2)).astype(np.int64) for c in (x, y))
        by = np.lexsort((at.to_numpy()[a], d, rj, ri, group[a]))
        key = np.stack([group[a], ri, rj])[:, by]
        new = np.ones(len(by), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        pick = by[new]
        yield pa.RecordBatch.from_arrays([track.take(pa.array(a[pick])), at.take(pa.array(a[pick])), at.take(pa.array(b[pick])), pa.array(d[pick]), pa.array(ri[pick]), pa.array(rj[pick])],
                                         names=[table.column_names[0], "reference", "current", "d", "ri", "rj"])


def _starts(table: pa.Table) -> np.ndarray:
    """Which rows have another track or tile than the row before."""
    new = np.ones(table.num_rows, bool)
    if len(new) > 1:
        new[1:] = False
        for i in (0, 5, 6):
            c = table.column(i).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, cut between tiles where ``TOGETHER`` of them have come."""
    held, rows, most = [], 0, TOGETHER
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(_starts(table))[-1])
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        most = max(TOGETHER, 2 * rows)  # a large tile is not looked through at each batch
    if held:
        yield pa.Table.from_batches(held)


def frame_report(pairs: DataFrame, track: str) -> DataFrame:
    """Per frame: attempts and successes of its pairs, and its worst score, a failed pair's counting three quarters."""
    score = F.when(F.col("accepted"), F.col("score")).otherwise(0.75 * F.col("score"))
    ends = pairs.select(track, F.inline(F.array(F.struct(F.col("reference").alias("frame"), F.col("current").alias("partner")), F.struct(F.col("current").alias("frame"), F.col("reference").alias("partner")))), "accepted", score.alias("value"))
    return ends.groupBy(track, "frame").agg(F.count("*").alias("attempts"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.min(F.struct("value", "partner")).alias("worst")).select(
        track, "frame", "attempts", "accepted", F.col("worst.value").alias("worst_score"), F.col("worst.partner").alias("worst_partner")
    )


def consensus_or_prediction(votes: DataFrame, predictions: DataFrame, key: Sequence[str], item: str, tolerance: float, lever: float) -> DataFrame:
    """Every prediction (``px``, ``py``, ``protation``), replaced by the consensus of its votes where there is one; turns are averaged about the prediction."""
    k = list(key)
    turned = votes.join(predictions.select(*k, "protation"), k).withColumn("rotation", P.wrap(F.col("rotation") - F.col("protation"))).drop("protation")
    agreed = _medians(turned, key, item, tolerance, lever)
    both = predictions.join(agreed, k, "left")
    return both.select(*k, F.col("inliers").isNotNull().alias("supported"), F.coalesce("x", "px").alias("x"), F.coalesce("y", "py").alias("y"), (F.col("protation") + F.coalesce("rotation", F.lit(0.0))).alias("rotation"))


def _medians(votes: DataFrame, key: Sequence[str], item: str, tolerance: float, lever: float) -> DataFrame:
    """As ``consensus``, the median turn taken as it stands."""
    k = list(key)
    a = votes.select(*k, F.col(item).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("rotation").alias("ar"))
    both = a.join(votes.select(*k, "x", "y", "rotation"), k)
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    near = both.where(F.sqrt(dx * dx + dy * dy) + F.abs(P.wrap(F.col("rotation") - F.col("ar"))) * lever <= tolerance)
    sets = near.groupBy(*k, "a").agg(F.count("*").alias("inliers"), *[stats.upper_quantile(stats.sorted_values(F.col(c)), 0.5).alias(c) for c in ("x", "y", "rotation")])
    best = sets.withColumn("k", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("inliers"), "a"))).where("k = 1")
    total = votes.groupBy(*k).agg(F.count("*").alias("votes"))
    return best.join(total, k).where("inliers >= 2 AND 2 * inliers > votes").select(*k, "inliers", "x", "y", "rotation")
