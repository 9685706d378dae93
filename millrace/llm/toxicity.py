"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding undoes homoglyphs and digits that stand for letters. Entries are whole words or beginnings of words, learned
from labelled documents with their log-odds as weights. A match inside an exception phrase doesn't count.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField

from millrace.llm.folds import FIT_ROWS, fit_sample
from millrace.llm.texts import map_texts
from millrace.sources.tables import written

# Letters of other scripts and the Latin ones that they look like.
HOMOGLYPHS = str.maketrans("аеорсухіјѕһԁӏвкмнтгпԛԝαερουκνιτχγωβ", "aeopcyxijshdlbkmhtrnqwaepoukvitxywb")
# What stands for letters inside words.
DIGITS = bytes.maketrans(b"0345789", b"oeastbg")
#: Phrases in which words of abuse are harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "white trash can", "clown fish", "class clown", "rodeo clown", "circus clown", "idiot proof", "idiot light", "village idiot pub", "pond scum", "scum line", "sore loser", "biggest loser", "loser bracket", "disgusting smell", "pathetic fallacy", "stupid simple", "oxy moron", "worthless check")
PREDICTED_FROM = 0.3

_SPACED = bytes((b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
_MIXED = re.compile(rb"(?:[a-z]+[0-9]|[0-9]+[a-z])[a-z0-9]*")
_SIGN = re.compile(rb"(?<![$@])[$@](?=[a-z])")
_OTHER_SCRIPT = re.compile(rb"[\xcd-\xd4]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def _undigit(m: re.Match) -> bytes:
    """1 stands for i or l, so that both readings are written."""
    if m[0].isdigit():
        return m[0]
    word = m[0].translate(DIGITS)
    return word.replace(b"1", b"i") + (b" " + word.replace(b"1", b"l") if b"1" in word else b"")


def folded(text: str | None) -> str:
    """Lower-cased words between single spaces, with one at either end."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        if _OTHER_SCRIPT.search(text.encode()):
            text = text.translate(HOMOGLYPHS)
    raw = text.encode()
    if b"$" in raw or b"@" in raw:
        raw = _SIGN.sub(lambda m: b"s" if m[0] == b"$" else b"a", raw)
    raw = raw.translate(_SPACED)
    if _MIXED.search(raw):
        raw = _MIXED.sub(_undigit, raw)
    return f" {b' '.join(raw.split()).decode()} "


@dataclass(frozen=True)
class Lexicon:
    """Entries ("^word$" or "^beginning") with weights, and the logistic curve over the normalised sum."""

    weights: tuple[tuple[str, float], ...]
    slope: float
    offset: float
    exceptions: tuple[str, ...] = EXCEPTIONS

    def score(self, total: float, words: int) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.offset + self.slope * normalised(total, words)))))


def normalised(total: float, words: int) -> float:
    """The sum of weights per doubling of the length: a word of abuse weighs less in a long text, yet isn't lost."""
    return total / math.log2(2 + words)


class Matcher:
    def __init__(self, weights: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> None:
        self.tree = ahocorasick.Automaton()
        for entry, weight in weights:
            word = entry[1:]
            key = f" {word[:-1]} " if word.endswith("$") else f" {word}"
            self.tree.add_word(key, (len(key), weight, entry))
        for phrase in exceptions:
            self.tree.add_word(f" {phrase} ", (len(phrase) + 2, None, phrase))
        self.tree.make_automaton()

    def hits(self, text: str) -> list[tuple[int, float, str]]:
        """(place, weight, entry) of entries that no exception holds. Of entries at one word the heaviest counts."""
        best: dict[int, tuple[float, str]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight, entry) in self.tree.iter(text):
            at = end - size + 1
            if weight is None:
                excused.append((at, end))
            elif at not in best or best[at] < (weight, entry):
                best[at] = (weight, entry)
        if excused:
            inside = {i for a, b in excused for i in range(a, b)}
            best = {at: x for at, x in best.items() if at not in inside}
        return [(at, *x) for at, x in sorted(best.items())]


def entries_of(word: str) -> list[str]:
    return [f"^{word}$", *(f"^{word[:n]}" for n in range(3, min(len(word), 12) + 1))]


def learn(samples: list[tuple[str, int]], most: int = 500) -> Lexicon:
    """Entries and weights from (distinct words between spaces, label) of each sample, without a curve. It is empty without
    both labels, and then its constant score tells which one there was.

    Entries are taken greedily, `most` of them at most: the one that adds most toxic documents less four times the clean
    ones, of equals the longest, then the last in order; until none adds three. Whole words that six toxic documents have, and at most a
    twentieth as many clean ones, follow even where other entries cover their documents.
    """
    entries = lambda ws: {e for w in ws.split() for e in entries_of(w)}
    toxic = [ws for ws, y in samples if y]
    clean_n = len(samples) - len(toxic)
    if not toxic or not clean_n:
        return Lexicon((), 0.0, -3.0 if not toxic else 0.0)
    counts: Counter = Counter()
    for ws in toxic:
        counts.update(entries(ws))
    held: dict[str, set[int]] = {e: set() for e, n in counts.items() if n >= 3}
    del counts
    against: dict[str, int] = defaultdict(int)
    for i, ws in enumerate(toxic):
        for e in entries(ws):
            if e in held:
                held[e].add(i)
    for ws, y in samples:
        if not y:
            for e in entries(ws):
                if e in held:
                    against[e] += 1
    gain = {e: len(ids) - 4 * against[e] for e, ids in held.items()}
    live, covered, chosen = {e for e, g in gain.items() if g >= 3}, set(), []
    while live and len(chosen) < most:
        entry = max(live, key=lambda e: (gain[e], len(e), e))
        if gain[entry] < 3:
            break
        chosen.append(entry)
        covered |= held[entry]
        live = {e for e in live if (n := len(held[e] - covered) - 4 * against[e]) >= 3 and (gain.__setitem__(e, n) or True)}
    chosen += [e for e in held if e.endswith("$") and e not in chosen and len(held[e]) >= 6 and 20 * against[e] <= len(held[e])]
    weigh = lambda e: math.log((len(held[e]) + 0.5) / len(toxic)) - math.log((against[e] + 0.5) / clean_n)
    return Lexicon(tuple((e, min(8.0, weigh(e))) for e in sorted(chosen)), 0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> tuple[float, float]:
    """Slope and offset by Newton's method."""
    design, b = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        g = design.T @ (p - y) + ridge * len(x) * np.array([b[0], 0]) / 10
        h = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * len(x) / 10 * np.diag([1.0, 0.0]) + 1e-9 * np.eye(2)
        move = np.linalg.solve(h, g)
        b -= move
        if abs(move).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from at most `rows` labelled documents whose crc32 remainder by 4 isn't 2.

    Entries come from the words of each; the curve is then fitted on the sums that scoring gives the same documents, with
    the exceptions.
    """
    sample = written(fit_sample(docs, labels, "toxic", 4, 2, rows, text), "fit-sample")
    seen = map_texts(sample, [StructField("words", StringType())], lambda: lambda texts: {"words": [" ".join(sorted(set(folded(t).split()))) for t in texts]}, text, ["label"], form="str")
    lexicon = learn([(r.words, int(r.label == 1)) for r in seen.collect()])
    if not lexicon.weights:
        return lexicon
    sums = [StructField("x", DoubleType())]

    def make() -> Callable[[list], dict]:
        matcher = Matcher(lexicon.weights, exceptions)

        def run(texts: list) -> dict:
            whole = [folded(t) for t in texts]
            return {"x": [normalised(sum(w for _, w, _ in matcher.hits(t)), t.count(" ") - 1) for t in whole]}

        return run

    got = np.array(sorted((r.x, float(r.label == 1)) for r in map_texts(sample, sums, make, text, ["label"], form="str").collect()))
    slope, offset = logistic(got[:, 0], got[:, 1])
    return Lexicon(lexicon.weights, slope, offset, exceptions)


FIELDS = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("n_matches", LongType()), StructField("matched", ArrayType(StringType()))]


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None, threshold: float = PREDICTED_FROM) -> DataFrame:
    """Adds score, predicted, n_matches and the entries matched.

    Null and empty texts have no matches and the score of none; very long texts are matched whole. Repeated rows are each scored; input columns named
    like an added one give way.
    """

    def make() -> Callable[[list], dict]:
        matcher = Matcher(lexicon.weights, lexicon.exceptions)

        def run(texts: list) -> dict:
            out: dict[str, list] = {f.name: [] for f in FIELDS}
            for t in texts:
                whole = folded(t)
                hits = matcher.hits(whole)
                p = lexicon.score(sum(w for _, w, _ in hits), whole.count(" ") - 1)
                for f, value in zip(FIELDS, (p, int(p >= threshold), len(hits), sorted({e for *_, e in hits})), strict=True):
                    out[f.name].append(value)
            return out

        return run

    return map_texts(docs, FIELDS, make, text, keep, form="str")
