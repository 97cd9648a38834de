import itertools
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import tokenizer as tk

tokenizers = pytest.importorskip("tokenizers")
PATH = tk.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(list(texts), add_special_tokens=False)]


def test_small_automaton():
    vocab = {bytes([b]): b for b in b"abc"} | {b"ab": 200, b"aa": 201, b"abc": 202, b"bc": 203}
    a = tk.MergeAutomaton(vocab, [(b"b", b"c"), (b"a", b"b"), (b"a", b"a"), (b"a", b"bc")])
    assert a.encode_word(b"abc") == [202] and a.encode_word(b"aaab") == [201, 200] and a.encode_word(b"aaa") == [201, 97]
    assert not a.arc(98, 99) and a.arc(99, 98)
    # Gadgets took out b-c, a-b (and a-bc), a-a (and a-ab, a-abc only after them), and what the new states inherit.
    states = [97, 98, 99, 200, 201, 202, 203]
    arcs = {(x, y) for x in states for y in states if a.arc(x, y)}
    assert (97, 98) not in arcs and (98, 99) not in arcs and (97, 97) not in arcs and {(99, 97), (99, 99), (202, 97), (201, 200)} <= arcs
    with pytest.raises(ValueError):
        a.encode_word(b"x")


def _merged(word, merges):
    parts = [word[i : i + 1] for i in range(len(word))]
    for u, v in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == u and parts[i + 1] == v:
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_any_merges_on_every_short_word(seed):
    rng = random.Random(seed)
    pieces, merges = [b"a", b"b", b"c"], []
    while len(merges) < 14:
        u, v = rng.choice(pieces), rng.choice(pieces)
        if u + v not in pieces:
            pieces.append(u + v)
            merges.append((u, v))
    vocab = {piece: i for i, piece in enumerate(pieces)}
    a = tk.MergeAutomaton(vocab, merges)
    for n in range(1, 8):
        for letters in itertools.product(b"abc", repeat=n):
            word = bytes(letters)
            assert [pieces[t] for t in a.encode_word(word)] == _merged(word, merges)
    for state in range(len(pieces)):
        assert a.arcs(state) == sum(a.arc(state, t) for t in range(len(pieces)))


def test_compiled_arcs_and_filled_table():
    a = tk.load_automaton(PATH)
    states = [t for t in range(len(a.label)) if a.sound[t]]
    assert len(states) > 50_000 and sum(map(len, a.out_step.values())) > 49_000
    some = [a.arcs(t) for t in states[:: len(states) // 50]]
    assert all(0 < n <= len(a.label) for n in some) and min(some) < len(a.label) - 100
    a.encode_word(b" tokenization")
    filled = len(a.table)
    assert filled >= 13
    a.encode_word(b" tokenization")
    assert len(a.table) == filled


def test_texts_agree_with_the_library(reference):
    rng = random.Random(1)
    signs = "'sstmdrevl  \n\t aA1é中!.,　​<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 18))) for _ in range(3000)] + ["x" * 20000, "ab " * 5000, "", " ", "\n\n a", "don't WE'LL we'll"]
    ids = tk.WordEncoder(tk.load_automaton(PATH)).encode(pa.array(texts))
    assert ids.to_pylist() == reference(texts)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_round_trip(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = tk.WordEncoder(tk.load_automaton(PATH)).encode(pa.array([text])).to_pylist()[0]
    assert tk.load_automaton(PATH).decode(ids) == text.encode()


def test_rank_file_gives_the_same_ids():
    texts = ["The quick brown fox", " naïve façade 12345", "trans-­port"]
    other = tk.WordEncoder(tk.load_automaton(tk.tokenizer_path("byte_bpe_50k.tiktoken")))
    assert other.encode(pa.array(texts)).to_pylist() == tk.WordEncoder(tk.load_automaton(PATH)).encode(pa.array(texts)).to_pylist()


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a", 0)], "doc_id bigint, text string, ids int")
    rows = tk.encode_texts(df, "doc_id", "text", PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in rows) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert tk.encode_texts(df.limit(0), "doc_id", "text", PATH).count() == 0
    assert tk.count_tokens(df, "text", PATH, "n", ["doc_id"]).where("n > 0").count() == 3
    assert tk.decode_ids(rows[2].ids, PATH) in ("", "a b")


def test_bytes_that_are_no_text():
    raw = pa.array([b"a\xff", b"ok"], pa.binary())
    out = tk.WordEncoder(tk.load_automaton(PATH)).encode(raw)
    assert tk.load_automaton(PATH).decode(out.to_pylist()[0]).decode() == "a�" and len(out) == 2
