"""Quality rules on tokeniser fertility, beside counts of symbols and repeats.

A public vocabulary measures characters per token, the share of byte-fallback tokens and the entropy of the tokens of
whole texts. Bands say which values ordinary text has; texts outside are rejected. The bands of a language (or script) with
enough texts come from the median and quartiles of its own texts, counted exactly over the table; others have fixed ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField

from millrace.llm.texts import Slots, map_texts, plain
from millrace.sources.tables import join_hot, written


@dataclass(frozen=True)
class Band:
    """Characters per token, byte-fallback share and evenness of tokens that ordinary text has.

    Evenness is the entropy of a text's tokens by the most that so many tokens can have, log2 of their number up to
    EVEN_TOKENS: repetitive and random text both fall short of ordinary text, whatever its length.
    """

    chars_per_token: tuple[float, float]
    most_fallback: float
    least_evenness: float


# The bands of each script. The vocabulary is mostly English, so other scripts have fewer characters per
# token; scripts it lacks fall back to bytes.
BANDS = {
    "latin": Band((1.3, 7.0), 0.10, 0.60),
    "cyrillic": Band((0.9, 5.0), 0.15, 0.60),
    "greek": Band((0.5, 4.0), 0.30, 0.55),
    "hebrew": Band((0.4, 3.0), 0.60, 0.50),
    "arabic": Band((0.4, 3.0), 0.60, 0.50),
    "devanagari": Band((0.3, 3.0), 0.85, 0.45),
    "thai": Band((0.3, 3.0), 0.85, 0.45),
    "hangul": Band((0.3, 2.5), 0.90, 0.50),
    "cjk": Band((0.3, 2.5), 0.85, 0.50),
    "other": Band((0.2, 8.0), 0.98, 0.40),
}
#: Shorter texts have no reliable measures and pass.
LEAST_TOKENS = 64
#: Different texts that a language needs for bands of its own.
LEAST_TEXTS = 200
#: How far bands reach from the median, in half the distance of the quartiles as a normal distribution's deviation: down and
#: up for characters per token, up for byte fallback, down for evenness. Below, the least that a deviation counts as.
REACH = {"chars_down": 4.0, "chars_up": 6.0, "fallback_up": 10.0, "even_down": 2.5}
LEAST_DEVIATION = {"chars": 0.02, "fallback": 0.004, "even": 0.01}
EVEN_TOKENS = 1024
# First and last code point of each script's letters, in order.
_SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0xD6), ("latin", 0xD8, 0xF6), ("latin", 0xF8, 0x24F), ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("thai", 0xE00, 0xE7F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
#: From here on, what is in none of the blocks counts for "other"; below are signs.
_OTHER_FROM = 0x250
_SIGNS = (0x2000, 0x2E7F)

SYMBOLS = b"#*$%&|<>"
FIELDS = [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [StructField("base_failed", BooleanType()), StructField("script", StringType()), StructField("n_tokens", LongType())] + [StructField(n, DoubleType()) for n in ("chars_per_token", "byte_fallback", "token_entropy")]
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))


@lru_cache(maxsize=2)
def piece_model(path: str):
    """The vocabulary, and which of its ids are fallback bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def script_of(text: str) -> str:
    """The script of most letters, in the order of BANDS for ties; "other" without letters of a known one."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "other"
    points, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
    held = dict.fromkeys(BANDS, 0)
    rest = counts * ((points >= _OTHER_FROM) & ((points < _SIGNS[0]) | (points > _SIGNS[1])))
    for name, a, b in _SCRIPTS:
        inside = (points >= a) & (points <= b)
        held[name] += int(counts[inside].sum())
        rest = rest * ~inside
    held["other"] = int(rest.sum())
    best = max(held, key=held.get)
    return best if held[best] else "other"


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more, the first included. Exact for any ids.

    Numbers for pairs of words, then pairs of pairs, and so on; equal numbers are equal windows. It ends early when
    all shorter windows differ.
    """
    n = len(ids)
    if n <= width:
        return 0
    names, step = ids.astype(np.int64), 1
    while step < width:
        top = int(names.max()) + 1
        names = names[: len(names) - step] * top + names[step:]
        _, names, counts = np.unique(names, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        step *= 2
    at = np.flatnonzero(counts[names] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _evenness() -> Column:
    return F.col("token_entropy") / F.log2(F.least(F.col("n_tokens"), F.lit(EVEN_TOKENS)).cast("double"))


def bands(measured: DataFrame, group: str, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(group, texts, chars_low, chars_high, most_fallback, least_even) of each group; the bands are null below `least_texts`.

    Texts of enough tokens that pass the base rule count, those with the same measures once, so that copies don't draw the
    bands to themselves. Quartiles are those of values rounded to thousandths, whose counts are all that a task gets of a group.
    """
    texts = measured.filter(~F.col("base_failed") & (F.col("n_tokens") >= LEAST_TOKENS)).select(group, "n_tokens", "chars_per_token", "byte_fallback", "token_entropy").distinct()
    parts = F.array(*(F.struct(F.lit(n).alias("measure"), F.round(c, 3).alias("value")) for n, c in (("chars", F.col("chars_per_token")), ("fallback", F.col("byte_fallback")), ("even", _evenness()))))
    counts = texts.select(group, F.inline(parts)).groupBy(group, "measure", "value").agg(F.count("*").alias("c"))
    mine = Window.partitionBy(group, "measure")
    placed = counts.withColumn("upto", F.sum("c").over(mine.orderBy("value"))).withColumn("n", F.sum("c").over(mine))
    at = lambda measure, p: F.min(F.when((F.col("measure") == measure) & (F.col("upto") >= F.ceil(F.lit(p) * F.col("n"))), F.col("value")))
    quartiles = placed.groupBy(group).agg(F.max("n").alias("texts"), *(at(m, p).alias(f"{m}{int(100 * p)}") for m in LEAST_DEVIATION for p in (0.25, 0.5, 0.75)))

    def limit(measure: str, up: bool, reach: str) -> Column:
        middle = F.col(f"{measure}50")
        half = F.col(f"{measure}75") - middle if up else middle - F.col(f"{measure}25")
        away = REACH[reach] * F.greatest(half / 0.6745, F.lit(LEAST_DEVIATION[measure]))
        return F.when(F.col("texts") >= least_texts, middle + away if up else middle - away)

    return quartiles.select(group, "texts", limit("chars", False, "chars_down").alias("chars_low"), limit("chars", True, "chars_up").alias("chars_high"), limit("fallback", True, "fallback_up").alias("most_fallback"), limit("even", False, "even_down").alias("least_even"))


def measure(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts, base_failed, script, n_tokens and the measures.

    Words are [^\\x20\\x09-\\x0D]+. Tokens are those of the whole text, however long, its white space included. Null and empty texts have no words, fail the base rule of 20 words, and have null
    measures. Repeated rows are each measured; input columns named like an added one give way.
    """

    def make() -> Callable[[list], dict]:
        model, is_byte = piece_model(vocabulary)

        def run(texts: pa.Array) -> dict:
            out: dict[str, list] = {f.name: [] for f in FIELDS}
            names = Slots()
            tokens = model.encode(pc.fill_null(texts, "").to_pylist(), num_threads=1)
            for raw, ids in zip(texts.cast(pa.large_binary()).to_pylist(), tokens, strict=True):
                raw, own = raw or b"", np.array(ids, np.int64)
                words = raw.split()
                n = len(words)
                joined = b"".join(words)
                chars = len(joined.translate(None, _CONTINUATION))
                symbols = len(raw.translate(None, _NOT_SYMBOL))
                repeated = repeated_words(names.numbers(words)) if n > 8 else 0
                failed = n < 20 or 100 * repeated > 30 * n
                script = per = fallback = entropy = None
                if len(own) and n:
                    script, per, fallback = script_of(raw.decode()), chars / len(own), float(is_byte[own].mean())
                    share = np.bincount(own)
                    share = share[share > 0] / len(own)
                    entropy = float(-(share * np.log2(share)).sum())
                row = (n, chars, symbols, duplicate_lines(raw), repeated, failed, script, len(own), per, fallback, entropy)
                for f, value in zip(FIELDS, row, strict=True):
                    out[f.name].append(value)
            return out

        return run

    return map_texts(docs, FIELDS, make, text, keep, form="arrow")


def assess(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, language: str | None = None, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """Adds what measure() does, kept, and the reason against a text: base, chars_per_token, byte_fallback or token_entropy.

    Null and empty texts fail the base rule. Texts below LEAST_TOKENS pass. `language` names a column whose texts share bands;
    without it, and where it is null, those of a script do, and languages with few different texts have the fixed bands of the
    text's script. What is kept of the input is written with the measures. An input column named like an added one gives way.
    """
    added = {f.name for f in FIELDS} | {"kept", "reason", "__group", "__texts"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    named = docs if language is None else docs.withColumn("__language", plain(language).cast("string"))
    measured = measure(named, vocabulary, text, [*kept, *(["__language"] if language else [])])
    script = F.coalesce("script", F.lit("other"))
    group = script if language is None else F.coalesce(F.concat(F.lit("language:"), F.col("__language")), script)
    measured = written(measured.withColumn("__group", group), "measures")
    held = measured.groupBy("__group").agg(F.count("*").alias("__texts"))
    facts = written(held.join(bands(measured, "__group", least_texts).drop("texts"), "__group", "left"), "bands")
    rows = join_hot(measured, facts, "__group", "__texts")
    fixed = lambda pick: F.create_map(*[x for n, b in BANDS.items() for x in (F.lit(n), F.lit(float(pick(b))))])[script]
    low, high, most, even = (F.coalesce(F.col(c), fixed(pick)) for c, pick in (("chars_low", lambda b: b.chars_per_token[0]), ("chars_high", lambda b: b.chars_per_token[1]), ("most_fallback", lambda b: b.most_fallback), ("least_even", lambda b: b.least_evenness)))
    chars = F.col("chars_per_token")
    reason = F.when(F.col("base_failed"), "base").when(F.col("n_tokens") < LEAST_TOKENS, None).when((chars < low) | (chars > high), "chars_per_token").when(F.col("byte_fallback") > most, "byte_fallback").when(_evenness() < even, "token_entropy")
    out = [*map(plain, kept), *(f.name for f in FIELDS[:6]), reason.alias("reason"), *(f.name for f in FIELDS[6:])]
    return rows.select(*out).withColumn("kept", F.col("reason").isNull())
