"""A mix of sources by target shares of all tokens, in blocks of equal length that hold token ids.

The texts of a source are put in pseudorandom order, cut into ranges of about equal size; each range is encoded
and its tokens are packed into blocks of fixed length, of which the last is shorter. The
mix is a run of slots, each of one block. A keyed permutation of all slots deals them to the sources by
their quotas, so that the counts of each output shard are a multinomial draw given the exact totals;
within a source the slot's rank is mapped through a keyed permutation of its blocks, another one for
every repetition. Slots and blocks are then joined by source and index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.tokenizer import token_encoder
from fieldloom.storage import Scratch

#: Tokens of a block, slots of an output shard, and letters of a range on average: the unit of work of packing.
BLOCK, SHARD, RANGE = 1024, 256, 1 << 20


#: Blocks that a task hands on at a time.
BATCH = 64


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The images of ``index`` under a permutation of range(``size``) chosen by ``key``.

    Four rounds over pairs of the nearest square, repeated for the few images beyond ``size``.
    """
    if size < 2:
        return np.zeros_like(index)
    side = np.uint64(int(np.ceil(np.sqrt(size))))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // side, out[todo] % side
        for turn in range(4):
            left, right = right, (left + _mixed(right, key * 4 + turn)) % side
        out[todo] = left * side + right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def quotas(shares: list[float], capacity: list[int], total: int | None) -> list[int]:
    """The blocks that each source gives to a mix of ``total`` blocks, at most its capacity.

    Without a total, the largest one is taken at which no source with blocks exceeds its capacity.
    Sources without blocks give none, and their share goes to the others in proportion.
    """
    live = [s if c > 0 else 0.0 for s, c in zip(shares, capacity, strict=True)]
    whole = sum(live)
    if whole <= 0:
        return [0] * len(shares)
    live = [s / whole for s in live]
    if total is None:
        total = int(min(c / s for s, c in zip(live, capacity, strict=True) if s > 0) + 1e-9)
    exact = [s * total for s in live]
    out = [int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return [min(q, c) for q, c in zip(out, capacity, strict=True)]


class Mix:
    """A mix planned from texts and targets; ``blocks()`` and ``report()`` give its rows."""

    def __init__(self, documents: DataFrame, targets: DataFrame, path: str, key: str = "doc_id", source: str = "source", text: str = "text",
                 total_tokens: int | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = 11):
        """``targets`` has ``source``, ``target_share`` and ``max_repeats``, a row for each source.

        ``total_tokens`` is the size of the mix; without it, the largest at which every source can
        have its share. A source whose share exceeds its texts times ``max_repeats`` gives all that it
        may, and the report says so. Texts of other or null sources are not used; null and empty texts
        have no tokens and never occur. Keys are unique and not null. Targets with a null source, no
        positive finite share or fewer than one repetition give nothing; a repeated source is an error.
        """
        self.spark, self.block, self.shard, self.seed = documents.sparkSession, block, shard, seed
        self.scratch = Scratch(self.spark, "mix")
        rows = targets.select("source", "target_share", "max_repeats").collect()  # one row for each source
        rows = sorted(r for r in rows if r["source"] is not None and r["target_share"] and 0 < r["target_share"] < float("inf") and (r["max_repeats"] or 0) > 0)
        self.sources = [r["source"] for r in rows]
        if len(set(self.sources)) < len(rows):
            raise ValueError("a source has more than one target")
        self.shares = [float(r["target_share"]) for r in rows]
        self.repeats = [int(r["max_repeats"]) for r in rows]
        self.ids = self.spark.createDataFrame(list(zip(self.sources, range(len(rows)), strict=True)), "source string, source_id int")
        used = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isin(self.sources))
        texts = used.where(F.length("text") > 0).join(F.broadcast(self.ids), "source").drop("source")
        sizes = {r["source_id"]: r["n"] for r in texts.groupBy("source_id").agg(F.sum(F.length("text").cast("long")).alias("n")).collect()}
        self.packed = self.scratch.save(self._packed(texts, path, [max(1, -(-sizes.get(i, 0) // RANGE)) for i in range(len(rows))]), "packed")
        found = {r["source_id"]: r["n"] for r in self.packed.groupBy("source_id").agg(F.sum("n_tokens").alias("n")).collect()}
        self.tokens = [found.get(i, 0) for i in range(len(rows))]
        held = {r["source_id"]: r["n"] for r in self.packed.groupBy("source_id").agg(F.count("*").alias("n")).collect()}
        self.held = [held.get(i, 0) for i in range(len(rows))]
        capacity = [n * r for n, r in zip(self.held, self.repeats, strict=True)]
        self.quota = quotas(self.shares, capacity, None if total_tokens is None else total_tokens // block)

    def _packed(self, texts: DataFrame, path: str, ranges: list[int]) -> DataFrame:
        """(``source_id, range, at, n_tokens, pieces, ids``): the blocks, with the pieces of texts that their ids are of.

        Texts are moved once, before they are encoded. A range is encoded and packed from its sorted texts as they stream
        by, so a task holds one block and one batch of them.
        """
        b = self.block
        order = F.xxhash64(F.lit(self.seed), "doc_id")
        rows = texts.withColumn("order", order).withColumn("range", F.pmod("order", F.element_at(F.lit(ranges or [1]), F.col("source_id") + 1)).cast("long"))
        placed = rows.repartition("source_id", "range").sortWithinPartitions("source_id", "range", "order", "doc_id").select("source_id", "range", "doc_id", "text")
        kind = dict(texts.dtypes)["doc_id"]
        piece = f"struct<at:int,doc_id:{kind},first_token:long,n_tokens:int>"

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, now, at, size, held, pieces = token_encoder(path), None, 0, 0, [], []
            out: list[tuple] = []

            def close() -> None:
                nonlocal at, size, held, pieces
                if held:
                    out.append((*now, at, size, pieces, np.concatenate(held)))
                    at, size, held, pieces = at + 1, 0, [], []

            def flush() -> pa.RecordBatch:
                columns = [list(c) for c in zip(*out, strict=True)]
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

            for batch in batches:
                cut = pa.struct([("at", pa.int32()), ("doc_id", batch.schema.field("doc_id").type), ("first_token", pa.int64()), ("n_tokens", pa.int32())])
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(cut), pa.list_(pa.int32())]
                lists = encoder.encode(batch.column("text"))
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                for row, where in enumerate(zip(batch.column("source_id").to_pylist(), batch.column("range").to_pylist(), strict=True)):
                    if where != now:
                        close()
                        now, at = where, 0
                    doc, ids, first = batch.column("doc_id")[row].as_py(), flat[ends[row] : ends[row + 1]], 0
                    while first < len(ids):
                        part = ids[first : first + b - size]
                        pieces.append({"at": size, "doc_id": doc, "first_token": first, "n_tokens": len(part)})
                        held.append(part.copy())
                        first, size = first + len(part), size + len(part)
                        if size == b:
                            close()
                        if len(out) >= BATCH:
                            yield flush()
            close()
            if out:
                yield flush()

        names = ["source_id", "range", "at", "n_tokens", "pieces", "ids"]
        return placed.mapInArrow(pack, f"source_id int, range long, at long, n_tokens int, pieces array<{piece}>, ids array<int>")

    def index(self) -> DataFrame:
        """(``source_id, block, range, at, n_tokens``): the blocks of each source, numbered through its ranges."""
        narrow = self.packed.select("source_id", "range", "at", "n_tokens")
        sizes = narrow.groupBy("source_id", "range").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("source_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        return narrow.join(starts, ["source_id", "range"]).select("source_id", (F.col("first") + F.col("at")).alias("block"), "range", "at", "n_tokens")

    def slots(self) -> DataFrame:
        """(``slot, shard, source_id, repeat, block``) of every slot."""
        total, ends = sum(self.quota), np.cumsum(self.quota)
        firsts, held, shard, seed = ends - self.quota, np.array(self.held), self.shard, self.seed

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column(0).to_numpy()
                place = permuted(slot, total, seed)
                source = np.searchsorted(ends, place, "right")
                repeat, rank = np.divmod(place - firsts[source], held[source])
                block = np.zeros_like(rank)
                for s, r in {*zip(source.tolist(), repeat.tolist(), strict=True)}:
                    pick = (source == s) & (repeat == r)
                    block[pick] = permuted(rank[pick], int(held[s]), seed + 1 + s * 1_000_003 + r)
                columns = [slot, slot // shard, source.astype(np.int32), repeat.astype(np.int32), block]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "shard", "source_id", "repeat", "block"])

        return self.spark.range(total).mapInArrow(deal, "slot long, shard long, source_id int, repeat int, block long")

    def blocks(self) -> DataFrame:
        """The mix: one row for each slot with its block, the ids packed in it and the pieces that they are of."""
        return (
            self.slots().join(self.index().drop("n_tokens"), ["source_id", "block"]).join(self.packed, ["source_id", "range", "at"]).join(F.broadcast(self.ids), "source_id")
            .select("shard", "slot", "source", "block", "repeat", "n_tokens", "pieces", "ids")
        )

    def report(self) -> DataFrame:
        """Of every source: its target and actual share of all tokens, its tokens, blocks and repetitions."""
        used = (
            self.slots().join(self.index(), ["source_id", "block"]).groupBy("source_id")
            .agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens"), (F.max("repeat") + 1).alias("repeats"))
        )
        rows = list(zip(range(len(self.sources)), self.sources, self.shares, self.repeats, self.tokens, strict=True))
        targets = self.spark.createDataFrame(rows, "source_id int, source string, target_share double, max_repeats int, held_tokens long")
        whole = used.agg(F.sum("tokens").alias("all"))
        return (
            targets.join(used, "source_id", "left").crossJoin(whole).select(
                "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("all")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.coalesce("blocks", F.lit(0)).alias("blocks"), "held_tokens", F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats")
        )
