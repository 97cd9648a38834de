from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import mixing, subjects
from fieldloom.llm.subject_terms import AREAS
from fieldloom.llm.tokenizer import encode_texts, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutations(size):
    image = mixing.permuted(np.arange(size), size, 5)
    assert sorted(image.tolist()) == list(range(size))


def test_quotas():
    assert mixing.quotas([0.5, 0.3, 0.2], [100, 100, 100], 10) == [5, 3, 2]
    assert mixing.quotas([0.5, 0.5], [10, 3], None) == [3, 3]
    assert mixing.quotas([0.5, 0.5], [10, 0], None) == [10, 0]
    assert mixing.quotas([0.9, 0.1], [4, 50], 20) == [4, 2]
    assert mixing.quotas([0.5], [0], None) == [0]


def _documents(spark):
    rows = [(i, "big", " word" * 40) for i in range(300)] + [(1000 + i, "mid", " other text" * 15) for i in range(60)] + [(2000, "one", " rare" * 300)]
    rows += [(3000, None, "lost"), (3001, "none", "lost"), (3002, "big", None), (3003, "mid", "")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_mix_has_its_shares(spark):
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.4, 3), ("one", 0.1, 2), ("absent", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(_documents(spark), targets, PATH, block=32, shard=8)
    rows = mix.blocks().collect()
    report = {r.source: r for r in mix.report().collect()}
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.shard for r in rows} == {r.slot // 8 for r in rows}
    assert sum(r.tokens for r in report.values()) == sum(r.n_tokens for r in rows)
    assert abs(report["big"].actual_share - 0.5 / 1.0) < 0.05 and abs(report["mid"].actual_share - 0.4) < 0.05 and report["absent"].tokens == 0
    uses = {}
    ids = {r.doc_id: r.ids for r in encode_texts(_documents(spark), "doc_id", "text", PATH).collect()}
    for r in rows:
        assert r.ids == [i for p in r.pieces for i in ids[p.doc_id][p.first_token : p.first_token + p.n_tokens]]
        assert [p.at for p in r.pieces] == np.cumsum([0] + [p.n_tokens for p in r.pieces])[:-1].tolist()
        assert sum(p.n_tokens for p in r.pieces) == r.n_tokens <= 32
        for p in r.pieces:
            for t in range(p.first_token, p.first_token + p.n_tokens):
                uses[p.doc_id, t] = uses.get((p.doc_id, t), 0) + 1
    most = {d: max(n for (e, _), n in uses.items() if e == d) for d, _ in uses}
    assert max(n for d, n in most.items() if d < 1000) <= 2 and max((n for d, n in most.items() if 1000 <= d < 2000), default=0) <= 3 and most[2000] <= 2
    assert not {3000, 3001, 3002, 3003} & set(most)
    assert [r.block for r in mixing.Mix(_documents(spark), targets, PATH, block=32).blocks().orderBy("slot").collect()] == [r.block for r in sorted(rows, key=lambda r: r.slot)]


def test_mix_of_a_given_size_and_of_nothing(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("one", 0.5, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.Mix(_documents(spark), targets, PATH, total_tokens=3200, block=32).report().collect()}
    assert report["big"].blocks == 50 and report["one"].tokens == 300 and report["one"].repeats == 1
    assert mixing.Mix(_documents(spark).limit(0), targets, PATH).blocks().count() == 0


def test_ranges_are_packed_each(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 3400)
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(_documents(spark), targets, PATH, block=32)
    index = mix.index().orderBy("block").collect()
    assert [r.block for r in index] == list(range(len(index))) and sum(r.n_tokens for r in index) == mix.tokens[0] == 300 * 40
    assert {r.range for r in index} == set(range(18)) and sum(r.n_tokens < 32 for r in index) <= 18
    rows = mix.blocks().collect()
    assert sorted(i for r in rows for p in r.pieces for i in [p.doc_id] * p.n_tokens) == [d for d in range(300) for _ in range(40)]


def test_cleaning_and_folding():
    assert subjects.clean_text("T&uuml;r <p>a  b</p>\nvaccine car-\nrier sol­\nvent\n- 3 -  1/2\nx") == "Tür a b vaccine carrier solvent x"
    assert subjects.clean_text("KanÃ¼le 换挡 杆") == "Kanüle 换挡杆"
    assert subjects.fold("re1ié") == subjects.fold("relie")


def test_every_term_finds_its_area():
    finder = subjects._finder()
    terms = subjects.weighted_terms()
    for i, (area, term, _) in enumerate(terms):
        found = {terms[j][0] for j in finder.find(f"Zu {term}." if term.isascii() else f"包括{term}。" if term[0] > "⺀" else f"Zu {term}.")}
        assert area in found, term
    assert set(AREAS) == {a for a, _, _ in terms} and len(AREAS) == 12


def test_ordinary_sentences_of_each_field():
    texts = {
        "medicine": "The surgeon gave antibiotics to the patient after the diagnosis.",
        "chemistry": "The catalyst speeds up the polymerisation of the monomer in toluene.",
        "software": "The compiler and the operating system run the sorting algorithm.",
        "telecom": "The antenna of the mobile phone sends data packets to the access point.",
        "agriculture": "The tractor spreads fertilizer before the crops are sown; cattle stay on the pasture.",
        "vehicles": "Das Kraftfahrzeug hat ein Getriebe und eine Bremsscheibe.",
        "energy": "L'éolienne charge la batterie lithium-ion par un redresseur.",
        "textiles": "The woven fabric of cotton fibre is sewn on a sewing machine.",
        "construction": "混凝土桥梁的地基和钢梁。",
        "optics": "The microscope has a lens of short focal length and a laser.",
        "food": "The dough is baked into bread; butter and sugar are added.",
        "sport": "The athlete plays football and basketball in the stadium.",
    }
    finder, terms = subjects._finder(), subjects.weighted_terms()
    for area, text in texts.items():
        hits = Counter()
        for term, n in finder.find(text).items():
            hits[terms[term][0]] += n
        assert hits.most_common(1)[0][0] == area and hits[area] >= 2, (area, hits)


def _areas(spark, df, labels=()):
    found = {}
    for r in subjects.subject_areas(df, spark.createDataFrame(list(labels), "doc_id bigint, area string"), "doc_id", "text").collect():
        found.setdefault(r.doc_id, set()).add(r.area)
    return found


def test_subjects_of_texts(spark):
    rows = [
        (1, "A stent and a catheter. A CATHETER holds the stent; the c1utch plate is none. The term was borrowed from the solar module."),
        (2, "Die Kanüle und der Stent, eine Spritze. Ähnliches ist von Lichtleiter bekannt, gehört aber nicht zur Erfindung. Die KanÃ¼le."),
        (3, "包括变矩器和传动轴，以及制动钳。类似原理见于基站，但不属于本发明。"),
        (4, None), (5, ""), (6, " \n\t"), (7, "This publication was withdrawn before grant."), (None, "a stent and a stent"),
        (8, "hash table hash table " * 3 + "lens barrel, eyepiece, lens barrel, prism face. " + "semester polyester"), (9, "stent catheter " * 60_000),
        (10, "zeolite, ester; zeolite, ester. brake caliper, wheel hub; brake caliper, wheel hub. bobbin, shuttle; bobbin, shuttle."),
        (11, "stent <span class='" + "x" * 500 + " brake caliper, brake caliper, brake caliper'> catheter"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, area string")
    assert _areas(spark, df) == {
        1: {"medicine", "vehicles"}, 2: {"medicine"}, 3: {"vehicles"}, 8: {"software", "optics"}, 9: {"medicine"}, 10: {"chemistry", "vehicles", "textiles"}, 11: {"medicine"},
    }
    assert _areas(spark, df.limit(0)) == {}
    assert _areas(spark, df, [(1, "Medicine "), (2, "medicine"), (10, "chemistry"), (10, "nonsense"), (None, "food"), (3, None)])[2] == {"medicine"}


def test_calibration(spark):
    rows = [(d, "food", 0.9, 5) for d in range(20)] + [(d, "sport", 0.1, 3) for d in range(20)] + [(99, "food", 0.9, 1)]
    scores = spark.createDataFrame(rows, "doc_id int, area string, score double, hits long")
    labels = spark.createDataFrame([(d, " Food") for d in range(20)] + [(3, None), (None, "food"), (4, "cooking")], "doc_id int, area string")
    least = subjects.calibrate(scores, labels, "doc_id")
    assert set(least) == set(AREAS) and all(0.1 < v < 0.9 for v in least.values())
    assert subjects.calibrate(scores, labels.limit(0), "doc_id") == dict.fromkeys(sorted(AREAS), 0.07)
