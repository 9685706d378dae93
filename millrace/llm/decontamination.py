"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over token windows of whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from millrace.llm.texts import map_texts, plain, words_of
from millrace.sources.tables import written

#: Words of benchmark text that are broadcast at once: some 100 MB in a task. More are scanned block after block.
BLOCK_WORDS = 200_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def window_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` ids; equal windows have equal hashes."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for j in range(width):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += mixed[j : j + n]
    return out


class NgramSet:
    """The windows of a block of benchmark items, with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int) -> None:
        self.names: list[str] = []
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, list[int]]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            m, at = min(width, len(ids)), len(self.names)
            self.names.append(name)
            for i in range(len(ids) - m + 1):
                found.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), []).append(at)
        self.by_width = {}
        for m, windows in found.items():
            keys = np.array(list(windows), np.int64).reshape(len(windows), m)
            hashes = np.array([window_hash(k, m)[0] for k in keys], np.uint64)
            order = np.argsort(hashes, kind="stable")
            held = list(windows.values())
            bits = np.zeros(1 << 22, bool)
            bits[(hashes >> np.uint64(42)).astype(np.int64)] = True
            self.by_width[m] = (bits, hashes[order], keys[order], [held[i] for i in order.tolist()])

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(start, width, items) of every occurrence of a window in ids, where 0 is a word of no item."""
        out = []
        for m, (bits, hashes, keys, held) in self.by_width.items():
            own = window_hash(ids, m)
            at = np.flatnonzero(bits[(own >> np.uint64(42)).astype(np.int64)])
            for i, k in zip(at.tolist(), np.searchsorted(hashes, own[at]).tolist(), strict=True):
                while k < len(hashes) and hashes[k] == own[i]:  # the same hash is checked word by word
                    if np.array_equal(keys[k], ids[i : i + m]):
                        out.append((i, m, held[k]))
                    k += 1
        return out


_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_FIELDS = [StructField("n_words", LongType()), StructField("hit_spans", ArrayType(_SPAN)), StructField("item_ids", ArrayType(StringType()))]


def _scan(docs: DataFrame, block: list[tuple[str, bytes | None]], width: int, text: str, keep: list[str] | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make() -> Callable[[list], dict]:
        grams = NgramSet(shared.value, width)
        number = grams.vocabulary.get

        def scan(texts: list) -> dict:
            split = [words_of(t) for t in texts]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.zeros(int(sizes.sum()) + len(split), np.int64)  # a 0 after each text, which no window holds
            ids[: len(ids)] = np.fromiter((number(w, 0) for ws in split for w in (*ws, b" ")), np.int64, len(ids))
            starts = np.cumsum(sizes + 1) - sizes - 1
            spans: list[list] = [[] for _ in split]
            items: list[set] = [set() for _ in split]
            hits = grams.hits(ids)
            rows = np.searchsorted(starts, [h[0] for h in hits], "right") - 1
            for (at, m, held), row in zip(hits, rows.tolist(), strict=True):
                spans[row].append((at - int(starts[row]), at - int(starts[row]) + m))
                items[row].update(held)
            return {"n_words": sizes.tolist(), "hit_spans": [merged(s) for s in spans], "item_ids": [sorted({grams.names[i] for i in s}) for s in items]}

        return scan

    return map_texts(docs, _FIELDS, make, text, keep)


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words without overlaps, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> list[DataFrame]:
    """Parts of the benchmark with about block_words words at most, unless one item has more."""
    held = benchmark.select(F.coalesce(plain(item_id).cast("string"), F.lit("")).alias("id"), plain(text).alias("text"))
    total = held.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    n = int(total // block_words) + 1
    return [held.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", mode: str = "annotate", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Marks, or takes out, what documents share with benchmark items.

    A window is `width` consecutive words of an item; a shorter item, if it has a word, is one window. mode:
    "annotate" adds n_words, hit_spans (word ranges, end exclusive) and item_ids (sorted, distinct);
    "documents" drops documents with a hit; "spans" cuts the hit words out of the texts.
    Null and empty texts have no words and stay. Items without words match nothing; an empty benchmark leaves all
    documents alone; a null item id counts as the empty string. Repeated rows are each judged. Input columns named like an added one give way to it.
    """
    names = {f.name for f in _FIELDS}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    if mode != "annotate" and text not in kept:
        kept.append(text)
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    out = None
    for part in blocks:
        items = [(r[0], r[1].encode() if r[1] is not None else None) for r in part.collect()]  # a block, of bounded size
        if out is None:
            out = _scan(docs, items, width, text, kept + [text] * (len(blocks) > 1 and text not in kept))
        else:
            before = out.withColumnsRenamed({"hit_spans": "__spans", "item_ids": "__items"})
            now = _scan(before, items, width, text, [*kept, *[text] * (text not in kept), "__spans", "__items"])
            joined = F.array_sort(F.concat("__spans", "hit_spans"))
            empty = F.array().cast(ArrayType(_SPAN))
            last = lambda a: F.element_at(a, -1)
            fold = F.aggregate(joined, empty, lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= last(a)["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))))
            out = written(now.withColumns({"hit_spans": fold, "item_ids": F.array_sort(F.array_union("__items", "item_ids"))}).drop("__spans", "__items"), "scanned")
    if len(blocks) > 1 and text not in kept:
        out = out.drop(text)
    if mode == "annotate":
        return out
    if mode == "documents":
        return out.filter(F.size("hit_spans") == 0).select(*map(plain, kept))
    return _without_spans(out, text).select(*map(plain, kept))


def _without_spans(found: DataFrame, text: str) -> DataFrame:
    """Cuts the ranges in hit_spans out of the texts; what stands between words is kept."""
    schema = found.schema
    at, of = found.columns.index(text), found.columns.index("hit_spans")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(of).to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    places = [m.span() for m in _WORD.finditer(raw)]
                    for s in reversed(spans):
                        raw = raw[: places[s["start"]][0]] + raw[places[s["end"] - 1][1] :]
                    texts[i] = raw.decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return found.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of annotated documents."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))
