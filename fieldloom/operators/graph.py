"""Pose graphs: components and their least-squares adjustment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import pose as P
from fieldloom.kernels.forest import folder
from fieldloom.operators.steps import chosen_in_order
from fieldloom.storage import Scratch


def components(nodes: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every node with the smallest frame of its component; lone nodes are their own.

    Edges are first folded into stars near each other. Then labels go to the least among neighbours and then jump to their label's label, so long chains close
    in few rounds. Each round is written to the shared folder.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    k = list(key)
    ordered = edges.select(*[F.col(c).cast("long").alias(c) for c in k], F.greatest("reference", "current").cast("long").alias("hi"), F.least("reference", "current").cast("long").alias("lo"))
    near = ordered.dropna().where("hi != lo").repartition(*k, F.floor(F.col("hi") / 4096))
    stars = scratch.save(near.mapInArrow(folder(k), ", ".join(f"{c} long" for c in [*k, "hi", "lo"])), "stars")
    both = stars.select(*k, F.col("hi").alias("frame"), F.col("lo").alias("other")).unionByName(stars.select(*k, F.col("lo").alias("frame"), F.col("hi").alias("other")))
    both = scratch.save(both.distinct(), "links")
    labels = scratch.save(nodes.select(*k, "frame", F.col("frame").alias("label")).distinct(), "labels0")
    n = 0
    while True:
        n += 1
        seen = both.join(labels.withColumnsRenamed({"frame": "other", "label": "near"}), [*k, "other"]).groupBy(*k, "frame").agg(F.min("near").alias("near"))
        low = scratch.save(labels.join(seen, [*k, "frame"], "left").select(*k, "frame", "label", F.least("label", F.coalesce("near", "label")).alias("low")), f"low{n}")
        after = lambda name: low.select(*k, F.col("frame").alias("low"), F.col("low").alias(name))
        one = low.join(after("far"), [*k, "low"]).select(*k, "frame", "label", F.col("far").alias("low"))
        two = one.join(after("far"), [*k, "low"])
        new = scratch.save(two.select(*k, "frame", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), f"labels{n}")
        scratch.drop(f"labels{n - 1}")
        scratch.drop(f"low{n}")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        labels = new.drop("moved")


#: Nodes from which a system is reduced before it is solved, nodes that are solved densely at most, and neighbours from which a node is not eliminated.
DENSE, CORE, CROWDED = 128, 1500, 48


def _merged(key: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the blocks of equal key, in the order of the keys."""
    if not len(key):
        return key, blocks
    order = np.argsort(key, kind="stable")
    key, blocks = key[order], blocks[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(blocks, start, axis=0)


def _conjugate(row: np.ndarray, col: np.ndarray, off: np.ndarray, diag: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Conjugate gradients with the inverse diagonal blocks, until the residual is 1e-12 of the right side or stands still."""
    n, inverse = len(diag), np.linalg.inv(diag)
    times = lambda v: np.einsum("nij,nj->ni", diag, v) + np.stack([np.bincount(row, c, n) for c in np.einsum("eij,ej->ei", off, v[col]).T], axis=1)
    x, r = np.zeros_like(right), right.copy()
    z = np.einsum("nij,nj->ni", inverse, r)
    d, rz = z.copy(), (r * z).sum()
    goal, best, still = 1e-12 * np.sqrt((right**2).sum()), np.inf, 0
    while (size := np.sqrt((r**2).sum())) > goal and still < 3 * n + 100:
        best, still = (size, 0) if size < best else (best, still + 1)
        q = times(d)
        share = rz / (d * q).sum()
        x, r = x + share * d, r - share * q
        z = np.einsum("nij,nj->ni", inverse, r)
        rz, old = (r * z).sum(), rz
        d = z + rz / old * d
    return x


def solved(n: int, row: np.ndarray, col: np.ndarray, blocks: np.ndarray, right: np.ndarray, dense: int = DENSE, core: int = CORE) -> np.ndarray:
    """The solution of a symmetric positive system of 3 by 3 blocks, given as entries that add up.

    Independent nodes of few neighbours are eliminated together, round by round, which takes a chain with a few
    long links in about log n rounds without much fill. What remains is solved densely, or by conjugate
    gradients where it is large.
    """
    key, values = _merged(row.astype(np.int64) * n + col, blocks)
    row, col = key // n, key % n
    diag = np.zeros((n, 3, 3))
    diag[row[row == col]] = values[row == col]
    row, col, off = row[row != col], col[row != col], values[row != col]
    right, alive, done, luck = right.copy(), np.ones(n, bool), [], np.random.default_rng(7)
    while alive.sum() > dense:
        degree = np.bincount(row, minlength=n)
        few = degree[alive].min()
        if few > CROWDED:
            break
        rank = luck.permutation(n) + n * degree  # distinct, so neighbours are never eliminated together
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, row, rank[col])
        out = alive & (rank < least) & (degree <= max(6, 2 * few))
        mine = out[row]
        e, j, b = row[mine], col[mine], off[mine]
        inverse = np.zeros_like(diag)
        inverse[out] = np.linalg.inv(diag[out])
        pull = np.einsum("eki,ekl->eil", b, inverse[e])  # entries are in the order of rows
        np.subtract.at(right, j, np.einsum("eij,ej->ei", pull, right[e]))
        each, first = degree[e], np.searchsorted(e, e)
        left = np.repeat(np.arange(len(e)), each)
        other = np.repeat(first, each) + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
        fill = -np.einsum("eij,ejk->eik", pull[left], b[other])
        own = j[left] == j[other]
        np.add.at(diag, j[left][own], fill[own])
        stay = ~mine & ~out[col]
        key, off = _merged(np.r_[row[stay] * n + col[stay], j[left][~own] * n + j[other][~own]], np.concatenate([off[stay], fill[~own]]))
        row, col = key // n, key % n
        done.append((np.flatnonzero(out), e, j, b, inverse[out]))
        alive &= ~out
    x, rest = np.zeros_like(right), np.flatnonzero(alive)
    place = np.zeros(n, np.int64)
    place[rest] = np.arange(len(rest))
    if len(rest) <= max(dense, core):
        full = np.zeros((len(rest), 3, len(rest), 3))
        full[np.arange(len(rest)), :, np.arange(len(rest))] = diag[rest]
        full[place[row], :, place[col]] = off
        x[rest] = np.linalg.solve(full.reshape(3 * len(rest), -1), right[rest].ravel()).reshape(-1, 3)
    else:
        x[rest] = _conjugate(place[row], place[col], off, diag[rest], right[rest])
    for out, e, j, b, inverse in reversed(done):
        pulled = right[out].copy()
        np.subtract.at(pulled, np.searchsorted(out, e), np.einsum("eij,ej->ei", b, x[j]))
        x[out] = np.einsum("nij,nj->ni", inverse, pulled)
    return x


def _adjust(nodes: pd.DataFrame, edges: pd.DataFrame, rounds: int, lever: float) -> tuple[np.ndarray, float, float]:
    """Gauss-Newton over x, y and rotation with weights (1 + r^2)^-2 of residuals; the first node stays."""
    frames = nodes["frame"].to_numpy()
    at = nodes[["x", "y", "rotation"]].to_numpy(float).copy()
    a, b = np.searchsorted(frames, edges["reference"].to_numpy()), np.searchsorted(frames, edges["current"].to_numpy())
    m, w = edges[["dx", "dy", "turn"]].to_numpy(float), edges["weight"].to_numpy(float)

    def residual(p: np.ndarray) -> np.ndarray:
        c, s = np.cos(p[a, 2]), np.sin(p[a, 2])
        turn = p[b, 2] - p[a, 2] - m[:, 2]
        return np.stack([p[a, 0] + c * m[:, 0] - s * m[:, 1] - p[b, 0], p[a, 1] + s * m[:, 0] + c * m[:, 1] - p[b, 1], lever * np.arctan2(np.sin(turn), np.cos(turn))], axis=1)

    def rms(p: np.ndarray) -> float:
        return float(np.sqrt((w[:, None] * residual(p) ** 2).sum() / w.sum()))

    before = rms(at)
    n = len(at)
    for _ in range(rounds):
        r = residual(at)
        robust = w / (1 + (r**2).sum(axis=1) / 400) ** 2
        c, s = np.cos(at[a, 2]), np.sin(at[a, 2])
        ja = np.zeros((len(a), 3, 3))
        ja[:, 0, 0] = ja[:, 1, 1] = 1
        ja[:, 0, 2], ja[:, 1, 2], ja[:, 2, 2] = -s * m[:, 0] - c * m[:, 1], c * m[:, 0] - s * m[:, 1], -lever
        jb = np.broadcast_to(np.diag([-1.0, -1.0, lever]), ja.shape)
        slopes, row, col, blocks = np.zeros((n, 3)), [], [], []
        for p, jp in ((a, ja), (b, jb)):
            np.add.at(slopes, p, np.einsum("e,eki,ek->ei", robust, jp, r))
            for q, jq in ((a, ja), (b, jb)):
                row.append(p), col.append(q), blocks.append(np.einsum("e,eki,ekj->eij", robust, jp, jq))
        row, col, blocks = np.concatenate(row), np.concatenate(col), np.concatenate(blocks)
        # The first node is left out of the system. Rotations count in the lever's units, and the ridge is small enough for the weak modes of long chains.
        inner, unit = (row > 0) & (col > 0), np.array([1.0, 1.0, 1 / lever])
        blocks, own = blocks[inner] * unit[:, None] * unit, np.arange(n - 1)
        ridge = np.broadcast_to(1e-13 * np.eye(3), (n - 1, 3, 3))
        step, share = np.zeros((n, 3)), 1.0
        step[1:] = solved(n - 1, np.r_[row[inner] - 1, own], np.r_[col[inner] - 1, own], np.concatenate([blocks, ridge]), -slopes[1:] * unit) * unit
        if not np.isfinite(step).all():
            break
        while share > 1 / 64 and rms(at + share * step) > rms(at) + 1e-9:
            share /= 2
        if share <= 1 / 64:
            break
        at += share * step
        if np.abs(step).max() < 1e-7:
            break
    return at, before, rms(at)


def adjusted_poses(nodes: DataFrame, edges: DataFrame, key: Sequence[str], rounds: int = 8, lever: float = 1000.0) -> DataFrame:
    """Nodes with poses that agree best with the measured edges, one solve per component.

    The smallest frame of a component stays. A solve that makes the residual larger is not used. A component
    is one sparse system, whatever its size, and its rows meet in one task.
    """
    k = list(key)
    label = components(nodes, edges, key)
    n = nodes.join(label, [*k, "frame"]).select(*k, "label", "frame", "x", "y", "rotation")
    e = edges.join(label.withColumnRenamed("frame", "reference"), [*k, "reference"]).select(*k, "label", "reference", "current", "dx", "dy", "turn", "weight")
    types = dict(nodes.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in k] + ["label bigint, frame bigint, x double, y double, rotation double, before_rms double, after_rms double"])

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("frame").reset_index(drop=True)
        out = left.assign(before_rms=np.nan, after_rms=np.nan)
        right = right[right["reference"].isin(left["frame"]) & right["current"].isin(left["frame"])]
        if len(left) > 1 and len(right):
            at, before, after = _adjust(left, right, rounds, lever)
            if np.isfinite(after) and after <= before + 1e-6:
                out[["x", "y", "rotation"]] = at
            else:
                after = before
            out["before_rms"], out["after_rms"] = before, after
        return out

    # Other names on the right, as both sides stem from the same columns.
    other = e.select(*[F.col(c).alias(c if c in ("reference", "current", "dx", "dy", "turn", "weight") else f"e_{c}") for c in e.columns])
    return n.groupBy(*k, "label").cogroup(other.groupBy(*[f"e_{c}" for c in [*k, "label"]])).applyInPandas(solve, schema)


def keyframes(path: DataFrame, track: str, order: str, spacing: float, turn_degrees: float = 25.0, gap: int = 256) -> DataFrame:
    """The rows that differ enough from the last chosen one, and both ends of each track.

    Sharp bends and the ends are found by windows; as the choice depends on the last chosen row, the rows then
    stream by in order, one task for a track, holding a batch and one row.
    """
    limit = float(np.radians(turn_degrees))
    by = Window.partitionBy(track).orderBy(order)
    rows = path.where("x IS NOT NULL").select(track, order, "x", "y", "rotation")
    step = rows.withColumns({"dx": F.lead("x").over(by) - F.col("x"), "dy": F.lead("y").over(by) - F.col("y")})
    before = step.withColumns({"bx": F.lag("dx").over(by), "by": F.lag("dy").over(by)})
    size = lambda x, y: F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)) > 1
    bend = F.abs(P.wrap(F.atan2("dy", "dx") - F.atan2("by", "bx"))) >= limit
    end = F.col("dx").isNull() | F.col("bx").isNull()
    marked = before.select(track, order, "x", "y", "rotation", F.coalesce(end | (size("dx", "dy") & size("bx", "by") & bend), end).alias("sure"))

    def choose(last: tuple | None, c: dict[str, np.ndarray], i: int) -> tuple[bool, tuple | None]:
        f, x, y, r = c[order][i], c["x"][i], c["y"][i], c["rotation"][i]
        if last is not None and not c["sure"][i]:
            turn = r - last[3]
            if f - last[0] < gap and abs(np.arctan2(np.sin(turn), np.cos(turn))) < limit and np.hypot(x - last[1], y - last[2]) < spacing:
                return False, last
        return True, (f, x, y, r)

    return chosen_in_order(marked, track, order, lambda: None, choose).drop("sure")
