"""Shared steps of the text operators: Arrow batches in bounded slices, words, and remembered token ids.

Texts are handled whole; only the number of rows that are in Python at once is bounded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 4 << 20

_KEEP = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: ASCII letters and digits and every byte of other characters make words; A-Z become a-z, the rest spaces.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b in _KEEP else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def cuts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of the column with about `limit` bytes each."""
    if not len(column):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64) + 16
    groups = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, b - a


def plain(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(docs: DataFrame, fields: list[StructField], make: Callable[[], Callable[[list], dict]], text: str = "text", keep: list[str] | None = None, form: str = "bytes", explode: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The kept columns (all by default) and `fields`, which make()() computes from a list of whole texts.

    make runs once in each task. The function it returns gets texts (form: a list of "bytes" or "str", None for null,
    or an "arrow" array) and gives a list for each field. With `explode` it also gives "row", the place in its list that each output row
    belongs to, so that a text has any number of rows. An input column with the name of a field gives way to it.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    frame = docs.select(*map(plain, kept), plain(text).cast("string").alias("__text__"))
    out = StructType([*frame.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, schema, n = make(), to_arrow_schema(out), len(kept)
        for batch in batches:
            texts = batch.column(n)
            for at, rows in cuts(texts, slice_bytes):
                part = texts.slice(at, rows)
                got = score(part if form == "arrow" else (part.cast(pa.large_binary()) if form == "bytes" else part).to_pylist())
                own = [batch.column(i).slice(at, rows) for i in range(n)]
                if explode:
                    own = [c.take(pa.array(got["row"], pa.int64())) for c in own]
                yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(own)] + [pa.array(got[f.name], schema.field(n + i).type) for i, f in enumerate(fields)], schema=schema)

    return frame.mapInArrow(run, out)


class Slots(dict):
    """Words to consecutive numbers; a new word gets the next one and joins `fresh`."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        slot = self[word] = len(self)
        self.fresh.append(word)
        return slot

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@lru_cache(maxsize=100_000)
def ends_in_letter(letter: str) -> bool:
    """Whether a letter's normal form ends in one: that of some, as \u0130 or \u095c, ends in a mark, which goes with a sign that follows."""
    return letter.isalpha() and (letter < "\u0100" or unicodedata.normalize("NFC", letter.lower())[-1:].isalpha())


class WordTokens:
    """Token ids of texts, taken word by word from a tokenizer that no token of leaves a word.

    Words are what single spaces and newlines separate. `encode` gives the ids of new words in a row and how many each
    has. They are remembered; beyond `limit` words the memory starts anew, which changes the time and not the result.
    With `lower`, words of Latin letters that differ in case, or in one full stop or comma at their end, are encoded
    once: it is for tokenizers that lower-case and part letters from signs.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], lower: bool = False, limit: int = 1_000_000) -> None:
        self.encode, self.lower, self.limit = encode, lower, limit
        self.ends = {sign: int(encode([sign])[0][0]) for sign in ".,"} if lower else {}
        self.cores = Slots()
        self._forget(0)

    def _forget(self, limit: int) -> None:
        """Cores are what costs time to encode; they stay while they are few enough."""
        self.slots, self.core_of, self.end_of = Slots(), np.zeros(0, np.int64), np.zeros(0, np.int32)
        if len(self.cores) >= limit:
            self.cores, self.flat = Slots(), np.zeros(0, np.int32)
            self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        if not (fresh := self.slots.fresh):
            return
        self.slots.fresh, cores, ends = [], [], []
        for w in fresh:
            core, end = (w[:-1], self.ends[w[-1]]) if w[-1:] in self.ends and ends_in_letter(w[-2:-1]) else (w, -1)
            cores.append(core.lower() if self.lower and core.isalpha() and max(core) < "\u0100" else core)
            ends.append(end)
        self.core_of = np.concatenate([self.core_of, self.cores.numbers(cores)])
        self.end_of = np.concatenate([self.end_of, np.array(ends, np.int32)])
        if self.cores.fresh:
            ids, n = self.encode(self.cores.fresh)
            self.cores.fresh = []
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
            self.counts = np.concatenate([self.counts, n])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids end."""
        if len(self.slots) > self.limit:
            self._forget(self.limit)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = pc.list_flatten(split).dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slots = self.slots.numbers(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        self._learn()
        core, end = self.core_of[slots], self.end_of[slots]
        has = end >= 0
        n = self.counts[core]
        full = n + has
        ends = np.cumsum(full)
        total = int(ends[-1]) if len(ends) else 0
        # Each id's place in flat; that of an end is one past its core's and is written over.
        at = np.repeat(self.starts[core] - (ends - full), full)
        at += np.arange(total)
        out = self.flat[np.minimum(at, len(self.flat) - 1, out=at)] if total else np.zeros(0, np.int32)
        out[ends[has] - 1] = end[has]
        return out, np.concatenate([[0], ends])[np.cumsum(sizes)]


@lru_cache(maxsize=2)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def json_word_tokens(path: str) -> WordTokens:
    """For a tokenizer file that drops white space and lower-cases. What it remembers goes with the task."""
    made = json_tokenizer(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters alone are one pre-token each, so that many of them go in one text."""
        lone = np.fromiter((w.isalpha() and max(w) < "\u0100" for w in words), bool, len(words))
        n, parts = np.zeros(len(words), np.int64), []
        for flag in (True, False):
            at = np.flatnonzero(lone == flag)
            for a in range(0, len(at), 4096):
                own = at[a : a + 4096]
                some = [words[i] for i in own.tolist()]
                if flag:
                    whole = made.encode(" ".join(some), add_special_tokens=False)
                    n[own] = np.bincount(np.array(whole.word_ids, np.int64), minlength=len(own))
                    parts.append((own, np.array(whole.ids, np.int32)))
                else:
                    each = [e.ids for e in made.encode_batch_fast(some, add_special_tokens=False)]
                    n[own] = list(map(len, each))
                    parts.append((own, np.array([i for x in each for i in x], np.int32)))
        ids, starts = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
        for own, got in parts:
            k = n[own]
            ids[np.repeat(starts[own] - (np.cumsum(k) - k), k) + np.arange(len(got))] = got
        return ids, n

    return WordTokens(encode, lower=True)


@lru_cache(maxsize=1)
def lasting_word_tokens(path: str) -> WordTokens:
    """The same with a memory that lasts as long as the Python worker: for jobs that do nothing else there."""
    return json_word_tokens(path)
