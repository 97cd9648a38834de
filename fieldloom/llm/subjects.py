"""Subject areas of texts, by weighted terms found with one multi-pattern automaton.

A text is normalised (entities, markup, wrong encodings, broken lines, blanks) and folded, so that letters
which optical recognition confuses are equal; the terms are folded alike. One pass of the automaton
finds all terms and the cues by which a sentence sets another field apart; terms in such sentences do
not count. A hit weighs the term's curated weight times its rarity among all texts times its specificity, the
share that its area has of the other hits in the texts that it occurs in. An area's score is the weight of
its hits over that of all hits and of a background that grows with the length of the text, and every area whose score
reaches its threshold is assigned. The thresholds are calibrated per area on labelled texts. What is sent to
the driver or broadcast is one number for each curated term or for each area and step of the score.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.subject_terms import AREAS, cues, weighted_terms
from fieldloom.storage import Scratch

#: Weight of the background for each thousand letters of a text, a Chinese sign counting as three letters.
BACKGROUND = 2.0
#: Texts that a specificity of 1 is taken for in advance, and labels that those of all areas count as for each area.
PRIOR_TEXTS, PRIOR_LABELS = 20, 200
#: Labelled texts that the thresholds are calibrated on at most, those of the smallest hashes; steps of the score.
LABELLED, STEPS = 20_000, 100

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_PAGE = re.compile(r"\n[ \t]*-[ \t]*\d+[ \t]*-[^\n]*(?=\n)")
_BREAK = re.compile(r"(?:­|(?<=\w)-)[ \t]*\r?\n[ \t]*(?=[a-zà-öø-ÿ])|­")
_CP1252 = {c: bytes([b]) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "replace")) != "�"}
_WRONG = re.compile("[\u0080-ÿ" + "".join(map(re.escape, _CP1252)) + "]{2,}")
_HAN_BLANK = re.compile(r"(?<=[㐀-鿿])\s+(?=[㐀-鿿])")
_HAN = re.compile("[⺀-鿿]")
_MARKS = re.compile("[̀-ͯ]+")
_FOLD = (("1", "l"), ("|", "l"), ("i", "l"), ("0", "o"), ("c", "e"), ("f", "t"), ("rn", "m"))
_FOLD_WIDE = (("’", "'"), ("​", ""), ("﻿", ""))
_STOPS = ".。!?;；"
_ENDINGS = ("s", "e", "n", "en", "es", "er", "x")


def _rightly(match: re.Match) -> str:
    raw = b"".join(_CP1252.get(c) or c.encode("latin-1", "ignore") for c in match.group())
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return match.group()


def clean_text(text: str) -> str:
    """The text without entities, markup, page lines, breaks in words and wrong encodings, on one line."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _WRONG.sub(_rightly, text))
    if "\n" in text:
        text = _BREAK.sub("", _PAGE.sub("", text))
    text = " ".join(text.split())
    return text if text.isascii() else _HAN_BLANK.sub("", text)


def fold(text: str) -> str:
    """Lower case without accents, with one letter for those that optical recognition confuses."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
        for old, new in _FOLD_WIDE:
            text = text.replace(old, new)
    for old, new in _FOLD:
        text = text.replace(old, new)
    return text


class TermFinder:
    """The automaton over terms and the cues of asides."""

    def __init__(self, terms: Sequence[str], cues: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            patterns.setdefault(fold(term), []).append(i)
        for phrase in cues:
            patterns.setdefault(fold(phrase), []).append(-1)
        for pattern, ids in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(ids), not pattern.isascii()))
        self.automaton.make_automaton()

    def find(self, text: str) -> Counter[int]:
        """How often each term occurs outside asides; a term within a longer one does not count."""
        return self.find_folded(fold(clean_text(text)))

    def find_folded(self, text: str) -> Counter[int]:
        hits: list[tuple[int, int, int]] = []
        asides: list[tuple[int, int]] = []
        for last, (length, ids, free) in self.automaton.iter(text):
            start, end = last - length + 1, last + 1
            if ids[0] == -1:
                if not (asides and asides[-1][0] <= start and end <= asides[-1][1]):
                    asides.append(self._sentence(text, start, end))
            elif free and "⺀" <= text[start] or self._whole(text, start, end):
                while hits and start <= hits[-1][0] and hits[-1][0] < end:
                    hits.pop()
                if not hits or end > hits[-1][1] and start >= hits[-1][1]:
                    hits.extend((start, end, i) for i in ids)
        return Counter(i for start, end, i in hits if not any(a <= start < b for a, b in asides))

    @staticmethod
    def _sentence(text: str, start: int, end: int) -> tuple[int, int]:
        first = max(text.rfind(s, 0, start) for s in _STOPS) + 1
        after = [p for s in _STOPS if (p := text.find(s, end)) >= 0]
        return first, min(after, default=len(text)) + 1

    @staticmethod
    def _whole(text: str, start: int, end: int) -> bool:
        if start and text[start - 1].isalpha():
            return False
        if end == len(text) or not text[end].isalpha() or text[end] >= "⺀":
            return True
        stop = end
        while stop < len(text) and stop - end < 3 and text[stop].isalpha():
            stop += 1
        return text[end:stop] in _ENDINGS


@lru_cache(maxsize=1)
def _finder() -> TermFinder:
    return TermFinder([term for _, term, _ in weighted_terms()], cues())


def term_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``length``, ``term``, ``hits``) for every curated term found in a text, by its place in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder()
        for batch in batches:
            at, sizes, terms, hits = [], [], [], []
            for row, value in enumerate(batch.column(1)):
                if value.is_valid:
                    folded = fold(clean_text(value.as_py()))
                    if found := finder.find_folded(folded):
                        wide = 0 if folded.isascii() else len(_HAN.findall(folded))
                        at += [row] * len(found)
                        sizes += [len(folded) + 2 * wide] * len(found)
                        terms += found.keys()
                        hits += found.values()
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            columns = [keys, pa.array(sizes, pa.int64()), pa.array(terms, pa.int32()), pa.array(hits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "length", "term", "hits"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"key {kind}, length long, term int, hits long")


def _rarity(found: DataFrame) -> DataFrame:
    """(``term``, ``area``, ``weight``): one row for each curated term that occurs, its weight times its rarity."""
    spark = found.sparkSession
    held = found.groupBy("term").agg(F.count_distinct("key").alias("held"))
    total = found.agg(F.count_distinct("key").alias("total"))
    terms = spark.createDataFrame([(i, a, w) for i, (a, _, w) in enumerate(weighted_terms())], "term int, area string, weight double")
    return terms.join(held, "term").crossJoin(total).select("term", "area", (F.col("weight") * F.log(1 + F.col("total") / F.col("held"))).alias("weight"))


def _specificity(found: DataFrame, rarity: DataFrame) -> DataFrame:
    """(``term``, ``specific``): the mean share of its area among the other hits of the texts with a term."""
    rows = found.join(F.broadcast(rarity), "term").select("key", "term", "area", (F.col("hits") * F.col("weight")).alias("w"))
    of_area = rows.groupBy("key", "area").agg(F.sum("w").alias("a"))
    of_text = of_area.groupBy("key").agg(F.sum("a").alias("all"), F.map_from_entries(F.collect_list(F.struct("area", "a"))).alias("parts"))  # twelve areas at most
    others = F.col("all") - F.col("w")
    share = F.when(others > 1e-9 * F.col("all"), (F.expr("parts[area]") - F.col("w")) / others)
    mean = (F.coalesce(F.sum(share), F.lit(0.0)) + PRIOR_TEXTS) / (F.count(share) + PRIOR_TEXTS)
    return rows.join(of_text, "key").groupBy("term").agg(mean.alias("specific"))


def area_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``area``, ``score``, ``hits``) of every area with a hit in a text."""
    scratch = Scratch(df.sparkSession, "subjects")
    found = scratch.save(term_hits(df, key, text), "hits")
    rarity = scratch.save(_rarity(found), "rarity")
    terms = scratch.save(rarity.join(_specificity(found, rarity), "term").select("term", "area", (F.col("weight") * F.col("specific")).alias("weight")), "terms")
    scored = found.join(F.broadcast(terms), "term").groupBy("key", "area").agg(
        F.sum(F.col("hits") * F.col("weight")).alias("score"), F.sum("hits").alias("hits"), F.max("length").alias("length")
    )
    parts = scored.groupBy("key").agg(F.collect_list(F.struct("area", "score", "hits")).alias("areas"), (F.sum("score") + BACKGROUND * F.max("length") / 1000).alias("all"))
    return parts.select(F.col("key").alias(key), F.inline("areas"), "all").select(key, "area", (F.col("score") / F.col("all")).alias("score"), "hits")


def subject_areas(df: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``area``, ``score``, ``hits``) of the areas that each text belongs to.

    ``labels`` (``key``, ``area``) are areas of some of the texts and may be wrong, repeated or unknown. The key is
    unique; rows with a null key, and null, empty, blank or unreadable texts, have no area. Texts are searched whole,
    whatever their length, and get every area that reaches its threshold. A repeated key counts as one text with the hits of all
    its rows and the length of the longest. Further columns are ignored.
    """
    scores = Scratch(df.sparkSession, "scores").save(area_scores(df, key, text), "scores")
    limits = df.sparkSession.createDataFrame(sorted(calibrate(scores, labels, key).items()), "area string, least double")
    return scores.join(F.broadcast(limits), "area").where(F.col("score") >= F.col("least")).select(key, "area", "score", "hits")


def _best_step(f1: np.ndarray, crowd: np.ndarray) -> float:
    """Of the steps at which ``f1`` is greatest those with the fewest scores around, and of these the middle."""
    top = np.flatnonzero(f1 >= f1.max() - 1e-9)
    few = top[crowd[top] == crowd[top].min()]
    return float(few[(len(few) - 1) // 2])


def calibrate(scores: DataFrame, labels: DataFrame, key: str, bound: int = LABELLED) -> dict[str, float]:
    """The least score of every area, that with the best F1 on at most ``bound`` labelled texts.

    Labels are compared without regard to case and outer blanks, repeated ones count once. An area is judged
    by its own counts and, as if they were ``PRIOR_LABELS`` more labels, by those of all areas; of equally good
    steps the one with the fewest scores of all texts around it is taken. Without any label it is 0.07.
    """
    names = sorted(AREAS)
    clean = labels.select(key, F.lower(F.trim("area")).alias("area")).dropna().where(F.col("area").isin(names)).distinct()
    chosen = clean.select(key).distinct().orderBy(F.xxhash64(key)).limit(bound)
    both = scores.join(chosen, key, "left_semi").join(clean.join(chosen, key, "left_semi").withColumn("given", F.lit(1)), [key, "area"], "full_outer")
    step = F.when(F.col("score").isNull(), -1).otherwise(F.least(F.lit(STEPS - 1), F.floor(F.col("score") * STEPS)))
    cells = both.groupBy("area", step.cast("int").alias("step"), F.coalesce("given", F.lit(0)).alias("given")).agg(F.count("*").alias("n"))
    counts = np.zeros((len(names), STEPS + 1, 2))  # the last column is that of labels without a hit
    for r in cells.collect():  # one row for each area, step and answer at most
        counts[names.index(r["area"]), r["step"], r["given"]] = r["n"]
    real = counts[..., 1].sum(axis=1)
    if not real.sum():
        return dict.fromkeys(names, 0.07)
    mixed = counts + counts.sum(axis=0) * (PRIOR_LABELS / real.sum())
    upward = mixed[:, STEPS - 1 :: -1].cumsum(axis=1)[:, ::-1]  # counts from each step on
    f1 = 2 * upward[..., 1] / (upward.sum(axis=2) + real[:, None] + PRIOR_LABELS)
    held = np.zeros(STEPS)
    for r in scores.groupBy(F.least(F.lit(STEPS - 1), F.floor(F.col("score") * STEPS)).cast("int").alias("step")).count().collect():  # one row for each step
        held[r["step"]] = r["count"]
    crowd = np.convolve(held, np.ones(3), "same")
    return {name: _best_step(f1[i], crowd) / STEPS for i, name in enumerate(names)}
