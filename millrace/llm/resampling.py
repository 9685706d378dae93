"""Importance resampling towards a target distribution, with an exact draw at any size.

Runs of one to three words are hashed into buckets, counted over all documents and over the target. A document's weight
is the sum of its features' gains, and Gumbel noise from its id turns the highest scores into a draw without return.
Scores are whole numbers: a histogram of them, summed from the highest down, says at which rank each score begins, so
that the cutoff is exact and only the rows above it are numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from millrace.llm.texts import WORD_BYTES, cuts, map_texts, plain
from millrace.operators.packets import prefix_sums
from millrace.sources.tables import join_hot, written

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Longest step that has a table of its own.
_DIRECT = 32


def _first_table() -> np.ndarray:
    """What one zero byte does to each value of a register's low byte (reflected CRC-32)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _advance(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Registers after the number of zero bytes that the table, by place and value of a byte, stands for."""
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


class Joiner:
    """CRC-32 of joined byte strings from those of their parts: crc(ab) is crc(a), moved on by len(b) zero bytes, xor crc(b)."""

    def __init__(self) -> None:
        one, byte = _first_table(), np.arange(256, dtype=np.uint32)
        step = np.stack([one, *(byte << (8 * k - 8) for k in (1, 2, 3))]).astype(np.uint32)  # places 1 to 3 move down
        direct = [np.stack([byte << (8 * k) for k in range(4)]).astype(np.uint32)]
        for _ in range(_DIRECT):
            direct.append(_advance(direct[-1], step))
        self.direct = np.stack(direct)  # [zero bytes, place, value]
        self.powers = [direct[_DIRECT]]  # of 32, 64, 128, ...

    def __call__(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = lengths % _DIRECT
        d = self.direct
        out = d[n, 0, first & 255] ^ d[n, 1, (first >> 8) & 255] ^ d[n, 2, (first >> 16) & 255] ^ d[n, 3, first >> 24]
        rest, bit = lengths // _DIRECT, 0
        while (at := np.flatnonzero(rest >> bit)).size:
            if bit == len(self.powers):
                self.powers.append(_advance(self.powers[-1], self.powers[-1]))
            at = at[(rest[at] >> bit) & 1 == 1]
            out[at] = _advance(out[at], self.powers[bit])
            bit += 1
        return out ^ second


def features(texts: pa.Array, joiner: Joiner, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, the bucket of each feature, and the text each feature is of. Whole texts; null has none."""
    lower = [t.translate(WORD_BYTES) if t else b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(lower, pa.large_binary()).cast(pa.large_string())))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(split).dictionary_encode()
    codes, distinct = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), [w.encode() for w in words.dictionary.to_pylist()]
    of = np.repeat(np.arange(len(lower)), sizes)
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    if distinct and not length.all():  # a text without words is one empty string here
        there = length[codes] > 0
        codes, of = codes[there], of[there]
    n = np.bincount(of, minlength=len(lower))
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[codes]
    after = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))[codes]
    length = length[codes] + 1
    pair = joiner(alone[:-1], after[1:], length[1:])
    triple = joiner(pair[:-1], after[2:], length[2:])
    two, three = of[:-1] == of[1:], of[:-2] == of[2:]
    return n, np.concatenate([alone, pair[two], triple[three]]) % np.uint32(buckets), np.concatenate([of, of[:-1][two], of[:-2][three]])


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all whole texts are in each bucket. Each task sums its own before the shuffle."""
    out = StructType([StructField("bucket", IntegerType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, total = Joiner(), np.zeros(buckets, np.int64)
        for batch in batches:
            for at, rows in cuts(batch.column(0)):
                total += np.bincount(features(batch.column(0).slice(at, rows), joiner, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], schema=to_arrow_schema(out))

    return docs.select(plain(text).cast("string")).mapInArrow(run, out).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) of each bucket, from all source and target texts."""
    counts = [{r.bucket: r.n for r in bucket_counts(f, text, buckets).collect()} for f in (source, target)]  # `buckets` rows at most
    s, t = counts
    all_s, all_t = (float(sum(c.values()) + buckets) for c in counts)
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * all_s / (float(s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_features and weight, the sum of the gains of a whole text's features."""
    fields = [StructField(n, LongType()) for n in ("n_words", "n_features", "weight")]

    def make():
        joiner, by_bucket = Joiner(), np.array(gain, np.int64)

        def run(texts: pa.Array) -> dict:
            n, bucket, of = features(texts, joiner, len(by_bucket))
            weight = np.bincount(of, by_bucket[bucket], len(n)).astype(np.int64)  # sums of whole numbers far below 2 ** 53
            return {"n_words": n, "n_features": np.bincount(of, minlength=len(n)), "weight": weight}

        return run

    return map_texts(docs, fields, make, text, keep, form="arrow")


def noise(doc_id: str, seed: int = SEED) -> Column:
    """1000 times standard Gumbel noise, rounded down, from the first 32 bits of a hash of the id. A null id is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(plain(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Adds n_words, n_features, weight, score and rank to each document; rank is null for those not drawn.

    Of the N documents with `least_words` words, the floor(percent N / 100) highest scores are drawn, ties to the smaller
    id. Null and empty texts have no features and weight 0; null ids come first among ties, and rows that agree in score
    and id are numbered in any order, each once. No documents, or too few to draw one, give no rank. An input column named
    like an added one gives way. Distinct scores are summed in ranges, and so are rows of one score, so that a score which
    a third of all rows have is shared among tasks.
    """
    added = ("n_words", "n_features", "weight", "score", "rank")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    named = [*kept, *([] if doc_id in kept else [doc_id])]
    scored = weigh(docs, gains(docs, target, text), text, named).withColumn("score", F.col("weight") + noise(doc_id, seed))
    scored = written(scored, "scores")
    whole = F.col("n_words") >= least_words
    histogram = scored.filter(whole).groupBy("score").agg(F.count("*").alias("c"))
    down = prefix_sums(histogram.select("score", "c", (-F.col("score")).alias("__down"), F.lit(0).alias("__all")), "__all", "__down", "c")
    begins = written(down.select("score", "c", (F.col("used") - F.col("c")).alias("__before")), "histogram")
    drawn = percent * (begins.agg(F.sum("c")).first()[0] or 0) // 100
    surviving = begins.filter(F.col("__before") < drawn)
    cutoff = surviving.agg(F.min("score")).first()[0]
    out = [*map(plain, kept), *map(F.col, added)]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(out)
    above = whole & (F.col("score") >= cutoff)
    turn = F.struct(plain(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"))
    placed = prefix_sums(scored.filter(above).withColumns({"__turn": turn, "__one": F.lit(1)}), "score", "__turn", "__one")
    ranked = join_hot(written(placed.withColumnRenamed("used", "__place"), "places"), surviving, "score", "c").withColumn("rank", F.col("__before") + F.col("__place"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(out).unionByName(scored.filter(~above).withColumn("rank", F.lit(None).cast("long")).select(out))


def oracle() -> str:
    """DuckDB's form of resample(documents, benchmark), with CRC-32 from its rule."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, {words} AS w FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {words} FROM benchmark),
placed AS (SELECT side, r, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
runs AS (SELECT side, r, array_to_string(w[i : i + k - 1], ' ') AS g FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
bytes AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM runs)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda p: (instr('0123456789ABCDEF', h[p]) * 16 + instr('0123456789ABCDEF', h[p + 1]) - 17)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
filed AS (SELECT side, r, bucket FROM runs JOIN hashed USING (g)),
counts AS (SELECT b.i AS bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM range({BUCKETS}) b(i) LEFT JOIN filed f ON f.bucket = b.i GROUP BY b.i),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM counts),
weighed AS (SELECT r, count(*) AS n_features, sum(g) AS weight FROM filed JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) >= {LEAST_WORDS} AS whole, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) AS BIGINT) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN whole AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE whole) // 100 THEN place END AS rank FROM ranked"""
