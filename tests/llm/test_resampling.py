"""The draw and its weights against a loop, on ties, repeated ids, hot scores, odd rows and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import resampling
from millrace.llm.texts import words_of
from tests.llm.test_operators import FOLDER, ODD, SCHEMA

TARGET = [(1, "many target words here, word word"), (2, None), (3, "")]


def buckets_of(text):
    w = words_of(text.encode() if text else None)
    return [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def loop(docs, target, percent=5):
    s, t = (Counter(b for x in side for b in buckets_of(x)[0]) for side in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, x in docs:
        own, n = buckets_of(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=repr)


def drawn(spark, docs, target, percent=5):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, frame, percent=percent, keep=["doc_id"]).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_checksums_of_joined_parts():
    draw, joiner = np.random.default_rng(0), resampling.Joiner()
    parts = [bytes(draw.integers(0, 256, n, np.uint8)) for n in [*range(70), 1000, 4096, 70_001]]
    first, second = parts, parts[::-1]
    got = joiner(np.array([zlib.crc32(a) for a in first], np.uint32), np.array([zlib.crc32(b) for b in second], np.uint32), np.array([len(b) for b in second]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(first, second)]


def test_features_of_odd_texts():
    own = [None, "", " . ", "one", "Two words", "a b c d", "é漢 x" * 3, "w" * 100 + " " + "v" * 40 + " u", "end"]
    n, bucket, of = resampling.features(pa.array(own), resampling.Joiner())
    for i, text in enumerate(own):
        want, words = buckets_of(text)
        assert (Counter(bucket[of == i].tolist()), n[i]) == (Counter(want), words)


def test_draw_against_a_loop(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()] + ODD
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for percent in (5, 60, 100, 0):
        assert drawn(spark, spark.createDataFrame(docs, SCHEMA).repartition(5), target, percent) == loop(docs, target, percent)


@pytest.mark.parametrize("ids", ["repeated", "null"])
def test_ties_of_rows_with_one_score(spark, ids):
    """A third of all rows have one id, or none, and one text, so that they share a score: each rank is given once."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(7 if ids == "repeated" else None, text)] * 1000 + [(100 + i, f"{text} own {i % 50}") for i in range(2000)]
    got = drawn(spark, spark.createDataFrame(docs, SCHEMA).repartition(9), [text], 50)
    want = loop(docs, [text], 50)
    assert got == want and sorted(r[5] for r in got if r[5]) == list(range(1, 1501))


def test_odd_rows_and_clashes(spark):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in ("score", "Rank", "weight", "extra")})
    got = resampling.resample(odd, target)
    assert got.columns == ["doc_id", "text", "extra", "n_words", "n_features", "weight", "score", "rank"] and got.count() == len(ODD)
    assert resampling.resample(odd.limit(0), target).collect() == []
    assert resampling.resample(odd, target.limit(0)).filter("rank is not null").count() == 0  # 5 % of two texts
