"""Packing against whole tokenisations and optima, and the token shortcut against the tokenizer."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, queries, texts, window_packing
from tests.llm.test_operators import FOLDER, ODD, SCHEMA

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


def ids_of(text):
    return texts.json_tokenizer(VOCABULARY).encode(text or "", add_special_tokens=False).ids


def shortcut(words):
    import pyarrow as pa

    ids, ends = texts.json_word_tokens(VOCABULARY)(pa.array(words, pa.string()))
    return [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def whole(words):
    return [e.ids for e in texts.json_tokenizer(VOCABULARY).encode_batch_fast(words, add_special_tokens=False)]


def test_tokens_of_every_letter_before_a_sign():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    for sign in ".,":
        words = [f"a{c}{sign}" for c in letters]
        assert shortcut(words) == whole(words)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    words = [f"{s}Ab{s}{s}c.{s} d,{s}" for s in spaces]
    assert shortcut(words) == whole(words)


def test_tokens_of_random_strings():
    draw = random.Random(4)
    parts = ["GAZETESİ,", "बड़.", "it's.", "don't,", "Über.", "ß,", "é.", "́", "漢字.", "..", ",.", "a.b,", "12.", "<|endoftext|>.", "ﬁ.", "ǆ,", " ", "\t", "\n", " ", "'s.", "x'.", "🙂.", "한글,", "ОНА."]
    points = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x300, 0x530), range(0x590, 0xA00), range(0xA00, 0x1200), range(0x1E00, 0x2100), range(0xFB00, 0xFE00)]
    made = ["".join(draw.choice(parts) if draw.random() < 0.3 else chr(draw.choice(draw.choice(points))) if draw.random() < 0.8 else draw.choice(" .,\n") for _ in range(draw.randrange(1, 14))) for _ in range(100_000)]
    made += ["GAZETESİ, bugün", "word ड़. next"]
    assert shortcut(made) == whole(made)


def least_bins(lengths, capacity):
    """The true optimum by trying all places, larger pieces first."""
    order, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= order[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - order[i]])
        place(i + 1, [*rooms, capacity - order[i]])

    place(0, [])
    return best[0]


def test_bound_and_fills_against_the_optimum():
    draw = random.Random(3)
    for k in range(300):
        capacity = draw.choice([7, 12, 30, 64])
        lengths = np.array([draw.randint(1, capacity) if k % 2 else draw.randint(capacity // 5 + 1, capacity // 2) for _ in range(draw.randint(1, 10))])
        bound, least = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity), least_bins(lengths.tolist(), capacity)
        assert bound <= least
        for make in (packing.best_fit_decreasing, packing.fill_by_pairs):
            bins, offsets, fill = make(lengths, capacity)
            assert len(fill) >= least and fill.max() <= capacity
            for b in range(len(fill)):
                own = sorted((int(offsets[i]), int(lengths[i])) for i in np.flatnonzero(bins == b))
                assert [a for a, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) == fill[b]


def test_middle_lengths_come_near_their_bound(spark):
    lengths = np.random.default_rng(2).integers(900, 1800, 8192)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    packed = packing.pack(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    used, most = packed.agg(F.count("*"), F.max("n")).first()
    assert most <= 4096 and used <= 1.02 * packing.lower_bound(np.bincount(lengths, minlength=4097), 4096)


def test_tree_finds_the_tightest_window():
    draw, tree, held = random.Random(5), window_packing.OpenWindows(300), []
    for window in range(3000):
        if draw.random() < 0.6:
            room = draw.randint(1, 300)
            tree.add(room, window)
            held.append((window, room))
        else:
            need = draw.randint(1, 300)
            got = tree.take(need)
            fits = [r for _, r in held if r >= need]
            assert (got[1] if got else None) == min(fits, default=None)
            if got:
                held.remove(got)


@pytest.mark.parametrize("kind", ["mixed", "large", "one", "equal", "tiny"])
def test_gaps_are_closed_and_every_token_is_kept(kind):
    draw = np.random.default_rng(8)
    lengths = {"mixed": draw.integers(1, 2048, 700), "large": draw.integers(1025, 2048, 500), "one": np.array([1500]), "equal": np.full(333, 1100), "tiny": draw.integers(1, 5, 90)}[kind]
    windows = window_packing.close_gaps([[(i, 0, int(lengths[i])) for i in w] for w in window_packing.best_fit(lengths, 2048)], 2048, 16)
    parts = sorted(p for w in windows for p in w)
    at = {}
    for piece, start, length in parts:
        assert start == at.get(piece, 0) and length > 0
        at[piece] = start + length
    assert at == {i: int(n) for i, n in enumerate(lengths)}
    for w in windows:
        n = sum(p[2] for p in w)
        assert n <= 2048 and (2048 - n <= 16 or n & (n - 1) == 0)


def test_window_packing_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "many words " * 9000), (-2, None), (-3, "")], SCHEMA))
    own = {r.doc_id: np.array([*ids_of(r.text), 1], "<u4") for r in docs.collect()}
    for per_partition in (4096, 40):
        rows = window_packing.pack(docs, VOCABULARY, keep=["doc_id"], per_partition=per_partition).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        assert set(by_doc) == set(own)
        for i, ids in own.items():
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        padding = 0
        for s in by_sequence.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding <= 0.002 * sum(map(len, own.values()))


def test_window_packing_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in ("length", "ids", "offset", "Piece", "extra")})
    rows = window_packing.pack(odd, VOCABULARY)
    assert rows.columns.count("length") == 1 and "extra" in rows.columns and "Piece" not in rows.columns
    assert sum(r.length for r in rows.collect()) == sum(len(ids_of(t)) + 1 for _, t in ODD)
    assert window_packing.pack(odd.limit(0), VOCABULARY).collect() == []
