"""Encoding of texts by a byte-level pair-merging tokenizer compiled into a token automaton.

The merges are compiled one after another, in their order, by a merge gadget. The automaton's states
are the tokens (the one read last) and its arcs are labelled with the token read next; at first it
has the 256 bytes, each following each. The gadget of the merge ``u v -> w`` adds the state and label
``w``, which is entered where ``u`` is and left as ``v`` is, and takes out every arc at which, at
the time of that merge, a ``u`` would stand directly before a ``v``. A path of the finished automaton
that spells a word is therefore the one tokenization that the merges give, and there is exactly one.

A state leaves as its right part does but for the arcs that later gadgets took out of it, and labels are
numbered so that what a gadget takes out is one interval. So all arcs, some two thousand millions, are held as one
interval for each merge. For encoding the automaton is spelled out in bytes and made deterministic; its
transition table is filled as states are first met. Words run through the table byte by byte, no step
is ever taken back, and as every prefix of a word has exactly one path too, each state has one last token:
the tokens of the word are read off from its end. Decoding emits the labels' bytes.
"""

from __future__ import annotations

import base64
import json
import os
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points that the split pattern takes as white space.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters of texts that are split at a time, and encoded words that a worker remembers.
BLOCK_BYTES, MEMORY = 4 << 20, 400_000
#: Transitions that a worker keeps; beyond, the table is started anew between two words.
TRANSITIONS = 2_000_000


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The vocabulary's file: in ``folder``, else in the installed collection of public ones."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in the JSON vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of a vocabulary; ``vocab`` maps the bytes of a token to its id."""

    def __init__(self, vocab: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        size = max(vocab.values(), default=-1) + 1
        self.label: list[bytes] = [b""] * size
        for piece, token in vocab.items():
            self.label[token] = piece
        # A state leaves as ``right`` did when its gadget was added at step ``born``, and is entered as ``left``.
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        # What gadgets took out of each state: steps, rising, and labels at first, intervals of places once laid out.
        self.out_step: dict[int, list[int]] = {}
        self.out_label: dict[int, list[int]] = {}
        taken: set[tuple[int, int]] = set()
        for step, (u, v) in enumerate(merges):
            if (pair := (vocab[u], vocab[v])) not in taken:
                taken.add(pair)
                self._gadget(step, *pair, vocab[u + v])
        self._lay_out()
        self._arcs: dict[int, bool] = {}
        self.sound = [self._sound(t) for t in range(size)]
        # The labels as a tree of bytes: node << 8 | byte -> node, node -> token.
        self.step: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for piece in sorted(vocab):
            if piece:
                self._spell(piece, vocab[piece])
        self._restart()

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        """The merge gadget: w enters as u and leaves as v, and u no longer stands before v."""
        if self.born[w] < 0 and len(self.label[w]) > 1:
            self.left[w], self.right[w], self.born[w] = u, v, step
        self.out_step.setdefault(u, []).append(step)
        self.out_label.setdefault(u, []).append(v)

    def _lay_out(self) -> None:
        """Places of the labels in which those that begin with a label, from a step on, are an interval.

        Labels follow the one that they begin with, the later ones first: so the labels that still begin with
        ``v`` at a step come right after ``v``.
        """
        later: dict[int, list[int]] = {}
        for w, u in enumerate(self.left):
            if u >= 0:
                later.setdefault(u, []).append(w)
        for w in later.values():
            w.sort(key=lambda t: -self.born[t])
        self.place, end = [0] * len(self.label), [0] * len(self.label)
        todo, at = [~t if leave else t for t in range(len(self.label)) if self.left[t] < 0 for leave in (False, True)][::-1], 0
        while todo:
            t = todo.pop()
            if t < 0:
                end[~t] = at
                continue
            self.place[t] = at
            at += 1
            for w in reversed(later.get(t, ())):
                todo += [~w, w]
        self.out_low: dict[int, np.ndarray] = {}
        self.out_high: dict[int, np.ndarray] = {}
        for u, labels in self.out_label.items():
            high = []
            for step, v in zip(self.out_step[u], labels, strict=True):
                begun = later.get(v, [])
                n = bisect_left(begun, -step + 1, key=lambda t: -self.born[t])  # of equal merges the left one comes first
                high.append(end[begun[n - 1]] if n else self.place[v] + 1)
            self.out_low[u], self.out_high[u] = np.array([self.place[v] for v in labels]), np.array(high)

    def _spell(self, piece: bytes, token: int) -> None:
        node = 0
        for b in piece:
            key = node << 8 | b
            nxt = self.step.get(key)
            if nxt is None:
                nxt = self.step[key] = len(self.token)
                self.token.append(-1)
                self.inner.append(False)
                self.inner[node] = True
            node = nxt
        self.token[node] = token

    def _taken_out(self, state: int, place: int, before: int) -> bool:
        """Whether a gadget older than ``before`` took the arc to the label at ``place`` out of ``state``."""
        ends = before
        while state >= 0:
            if (low := self.out_low.get(state)) is not None:
                n = bisect_left(self.out_step[state], ends)
                if ((low[:n] <= place) & (place < self.out_high[state][:n])).any():
                    return True
            ends, state = min(before, self.born[state]), self.right[state]
        return False

    def arc(self, a: int, b: int) -> bool:
        """Whether state ``a`` has an arc labelled ``b``."""
        key = a << 32 | b
        if (known := self._arcs.get(key)) is None:
            known = self._arcs[key] = not self._taken_out(a, self.place[b], sys.maxsize)
        return known

    def arcs(self, a: int) -> int:
        """How many arcs the state ``a`` has."""
        gone = np.zeros(len(self.label), bool)
        ends = sys.maxsize
        while a >= 0:
            for low, high in zip(self.out_low.get(a, ())[: bisect_left(self.out_step.get(a, []), ends)], self.out_high.get(a, ()), strict=False):
                gone[low:high] = True
            ends, a = self.born[a], self.right[a]
        return int(np.count_nonzero(~gone))

    def _sound(self, token: int) -> bool:
        """Whether the token is what its own bytes give: when its gadget was added, its right part could follow its left one."""
        if self.born[token] < 0:
            return len(self.label[token]) == 1
        return not self._taken_out(self.left[token], self.place[self.right[token]], self.born[token])

    def _restart(self) -> None:
        """An empty transition table. A state of it is the labels begun: the token before each, and the node reached."""
        self.table: dict[int, int] = {}
        self.last = [-1]
        self._begun: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self._number: dict[tuple[tuple[int, int], ...], int] = {self._begun[0]: 0}

    def _transition(self, state: int, byte: int) -> int:
        """Fills in the table: the labels begun read the byte, and the one that ends there by an arc is the last token."""
        begun, last = [], -1
        for before, node in self._begun[state]:
            if (node := self.step.get(node << 8 | byte, -1)) >= 0:
                if self.inner[node]:
                    begun.append((before, node))
                t = self.token[node]
                if t >= 0 and self.sound[t] and (before < 0 or self.arc(before, t)):
                    last = t
        if last < 0:
            raise ValueError(f"the vocabulary has no path that goes on with byte {byte}")
        key = (*begun, (last, 0))
        if (nxt := self._number.get(key)) is None:
            nxt = self._number[key] = len(self._begun)
            self._begun.append(key)
            self.last.append(last)
        self.table[state << 8 | byte] = nxt
        return nxt

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the path that spells ``word``."""
        if len(self.table) > TRANSITIONS:
            self._restart()
        table, last, state, ends = self.table, self.last, 0, []
        for byte in word:
            nxt = table.get(state << 8 | byte)
            state = self._transition(state, byte) if nxt is None else nxt
            ends.append(last[state])
        path, at = [], len(word)
        while at:
            t = ends[at - 1]
            path.append(t)
            at -= len(self.label[t])
        return path[::-1]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that the labels emit."""
        return b"".join(self.label[i] for i in ids)

    @classmethod
    def from_json(cls, path: str) -> MergeAutomaton:
        """From a byte-level vocabulary in JSON; special tokens are left out."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        table = _byte_of_char()
        raw = lambda s: bytes(table[c] for c in s)
        vocab = {raw(s): i for s, i in model["vocab"].items() if all(c in table for c in s)}
        return cls(vocab, ((raw(u), raw(v)) for u, v in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])))

    @classmethod
    def from_ranks(cls, path: str) -> MergeAutomaton:
        """From a rank file (base64 of a token, rank), where a token's merge is its best earlier split."""
        with open(path, "rb") as f:
            vocab = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        merges = []
        for piece, rank in sorted(vocab.items(), key=lambda kv: kv[1]):
            if len(piece) > 1:
                parts = [piece[i : i + 1] for i in range(len(piece))]
                while len(parts) > 2:
                    ranked = [(vocab.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1)]
                    best, i = min(ranked)
                    if best >= rank:
                        break
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if len(parts) == 2:
                    merges.append((parts[0], parts[1]))
        return cls(vocab, merges)


@lru_cache(maxsize=4)
def load_automaton(path: str) -> MergeAutomaton:
    """Compiled once per worker."""
    return MergeAutomaton.from_ranks(path) if path.endswith(".tiktoken") else MergeAutomaton.from_json(path)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[SPACES] = SPACE
    return table


def split_words(text: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where words start in the code points ``text``, whose documents start where ``doc_start`` says.

    The rule is that of the public pattern: runs of letters, of numbers or of other signs, each with
    one blank before it; white space but for its last character; contractions after an apostrophe.
    """
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[text]
    start = doc_start.copy()
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    run = start.copy()
    # The last white space before a run is a word of its own or, if a blank, joins the run.
    at = np.flatnonzero(run[1:] & ~doc_start[1:] & (kind[:-1] == SPACE)) + 1
    start[at - 1] = True
    start[at[text[at - 1] == 32]] = False
    at = np.flatnonzero((text[:-1] == 39) & start[:-1] & run[1:] & (kind[1:] == LETTER) & ~doc_start[1:])
    if len(at):
        padded = np.concatenate([text, np.zeros(4, text.dtype)])
        same = np.concatenate([~run, np.zeros(4, bool)])  # goes on with the run of its left neighbour
        one, two = padded[at + 1], np.where(same[at + 2], padded[at + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[at[short | long] + 1] = False
        for where, width in ((at[short], 2), (at[long], 3)):
            rest = where + width
            rest = rest[rest < n]
            start[rest] = True
    return start


class WordEncoder:
    """Encodes Arrow string arrays; remembers the words it has met."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.known: dict[bytes, list[int]] = {}

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text; empty for an empty and for a null text."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        parts, at, sizes = [], 0, np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        ends = np.cumsum(sizes)
        while at < len(texts):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
            parts.append(self._block(texts.slice(at, to - at)))
            at = to
        return pa.chunked_array(parts, pa.list_(pa.int32())).combine_chunks() if parts else pa.array([], pa.list_(pa.int32()))

    def _block(self, texts: pa.Array) -> pa.ListArray:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = (data.to_pybytes() if data else b"")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        try:
            decoded = raw.decode("utf-8")
        except UnicodeDecodeError:  # not text; every stray byte becomes the replacement character
            fixed = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return self._block(pa.array(fixed, pa.large_binary()))
        points = np.frombuffer(decoded.encode("utf-32-le"), np.uint32)
        octets = np.frombuffer(raw, np.uint8)
        first = np.flatnonzero((octets & 0xC0) != 0x80)  # the byte at which each code point starts
        doc_start = np.zeros(len(points), bool)
        nonempty = offsets[:-1][np.diff(offsets) > 0]
        doc_start[np.searchsorted(first, nonempty)] = True
        word_at = first[split_words(points, doc_start)]
        bounds = np.append(word_at, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(word_at), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        distinct = [self._ids(w) for w in words.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, distinct), np.int32, len(distinct))
        flat = np.fromiter((i for ids in distinct for i in ids), np.int32, int(lengths.sum()))
        by_word = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(flat))
        index = words.indices.to_numpy()
        out = by_word.take(words.indices).flatten()
        tokens_before = np.append(0, np.cumsum(lengths[index], dtype=np.int64))
        return pa.ListArray.from_arrays(pa.array(tokens_before[np.searchsorted(word_at, offsets)].astype(np.int32)), out)

    def _ids(self, word: bytes) -> list[int]:
        if (ids := self.known.get(word)) is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            ids = self.automaton.encode_word(word)
            if len(word) < 64:
                self.known[word] = ids
        return ids


@lru_cache(maxsize=4)
def token_encoder(path: str) -> WordEncoder:
    """One for each worker and vocabulary."""
    return WordEncoder(load_automaton(path))


def encode_texts(df: DataFrame, key: str, text: str, path: str, ids: str = "ids", keep: Iterable[str] = ()) -> DataFrame:
    """``key``, the columns ``keep`` and the token ids of ``text`` for each row, without special tokens.

    ``path`` is the vocabulary file (JSON or ranks) and must be readable on every executor. Empty and
    null texts both give an empty list, so that every row has ids; a special token's string is
    ordinary text. The key may be null or repeated, further columns are ignored. Texts of any length
    are encoded whole; memory is bound by the batch, not by the table.
    """
    held = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], encoder.encode(batch.column(len(held)))], names=[*held, ids])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in held]
    return df.select(*held, text).mapInArrow(run, ", ".join([*fields, f"`{ids}` array<int>"]))


def count_tokens(df: DataFrame, text: str, path: str, count: str = "n_tokens", keep: Iterable[str] = ()) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``; 0 for an empty and for a null text."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(path)
        for batch in batches:
            sizes = pc.list_value_length(encoder.encode(batch.column(len(keep)))).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=[*keep, count])

    fields = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{count}` bigint"])
    return df.select(*keep, text).mapInArrow(run, fields)


def decode_ids(ids: Iterable[int], path: str) -> str:
    """The text of a list of ids."""
    return load_automaton(path).decode(ids).decode("utf-8", "replace")

