"""Edges rewritten as stars with the same components, a block at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Edges that a task folds at a time.
FOLD_EDGES = 400_000


def star_forest(keys: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges with the same components, each from a node to the smallest of its component here.

    Returns the positions (in the doubled endpoint list) of the member and of the smallest member.
    """
    n = len(a)
    node = np.concatenate([a, b])
    scope = [np.concatenate([k, k]) for k in keys]
    order = np.lexsort([node, *scope[::-1]])
    new = np.zeros(2 * n, bool)
    new[0] = True
    for x in [node, *scope]:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    dense = np.empty(2 * n, np.int64)
    dense[order] = np.cumsum(new) - 1
    first = order[new]
    u, v = dense[:n], dense[n:]
    parent = np.arange(len(first))
    while True:
        low = np.minimum(parent[u], parent[v])
        before = parent.copy()
        for end in (u, v, before[u], before[v]):
            np.minimum.at(parent, end, low)
        while (up := parent[parent] < parent).any():
            parent[up] = parent[parent[up]]
        if (before == parent).all():
            break
    member = np.flatnonzero(parent != np.arange(len(first)))
    return first[member], first[parent[member]], node


def folder(scope: Sequence[str]):
    """A function for ``mapInArrow`` that folds edges (``scope``, ``hi``, ``lo``, all bigint) of a partition into stars, in blocks."""
    schema = pa.schema([(c, pa.int64()) for c in [*scope, "hi", "lo"]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = [table[c].to_numpy() for c in scope]
            hi, lo, node = star_forest(keys, table["hi"].to_numpy(), table["lo"].to_numpy())
            columns = [np.concatenate([k, k])[hi] for k in keys] + [node[hi], node[lo]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= FOLD_EDGES:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return fold
