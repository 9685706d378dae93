"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets verify them.

Documents with the same n-gram set are one class, so that copies cost one row. Classes that share a band hash are
candidates of each other; groups of them are compared in blocks of bounded size, which give counts of links and a
spanning forest, never the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from millrace.llm.components import components
from millrace.llm.texts import Slots, map_texts, plain, words_of
from millrace.sources.tables import join_hot, written

#: Classes in a block; two blocks meet in one task at most.
BLOCK = 128
#: Larger groups of candidates are compared bucket by bucket. Either way a link is a similar pair that shares a bucket, so
#: that the number changes the work and not the result.
WHOLE_GROUP = 20_000


def choose_bands(threshold: float, recall: float, most_hashes: int = 144) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which a pair at the threshold is found with
    the wanted probability."""
    for rows in range(most_hashes, 0, -1):
        bands = most_hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows
    raise ValueError("no number of bands reaches this recall")


class Shingler:
    """Sets of hashed word n-grams. Word hashes are remembered up to a number of words."""

    def __init__(self, width: int, limit: int = 500_000) -> None:
        self.width, self.limit = width, limit
        self.slots, self.hashes = Slots(), np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of each text's n-grams. Fewer words than n are one n-gram, none are none."""
        if len(self.slots) > self.limit:
            self.slots, self.hashes = Slots(), np.zeros(0, np.uint64)
        split = [words_of(t) for t in texts]
        slots = self.slots.numbers([w for ws in split for w in ws])
        if self.slots.fresh:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, self.slots.fresh), np.uint64, len(self.slots.fresh))])
            self.slots.fresh = []
        words, at, out = self.hashes[slots], 0, []
        for ws in split:
            own, at = words[at : at + len(ws)], at + len(ws)
            n = min(self.width, len(own))
            total = np.zeros(max(0, len(own) - n + 1) if n else 0, np.uint64)
            for j in range(n):
                total = total * np.uint64(0xD6E8FEB86659FD93) + own[j : j + len(total)]
            out.append(np.unique(total ^ (total >> np.uint64(31))))
        return out


def signature_hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 32, n, np.uint32), draw.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of each non-empty set's MinHash signature."""
    flips, factors = signature_hashes(bands * rows)
    x = np.concatenate(sets).view(np.uint32)[::2] if sets else np.zeros(0, np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sets), (b + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat((x ^ flips[i]) * factors[i], starts) if len(sets) else h
            h = (h ^ least.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        out[:, b] = h
    return out.view(np.int64)


def _signed(docs: DataFrame, width: int, bands: int, rows: int, text: str, keep: list[str]) -> DataFrame:
    """digest of the n-gram set and band hashes; null for texts without words."""
    fields = [StructField("digest", BinaryType()), StructField("bands", ArrayType(LongType()))]

    def make() -> Callable[[list], dict]:
        shingler = Shingler(width)

        def run(texts: list) -> dict:
            sets = shingler.sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            digests: list = [None] * len(sets)
            signed: list = [None] * len(sets)
            for i, h in zip(full, band_hashes([sets[i] for i in full], bands, rows), strict=True):
                digests[i], signed[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), h
            return {"digest": digests, "bands": signed}

        return run

    return map_texts(docs, fields, make, text, keep)


def _with_sets(docs: DataFrame, width: int, text: str, keep: list[str]) -> DataFrame:
    def make() -> Callable[[list], dict]:
        shingler = Shingler(width)
        return lambda texts: {"grams": [s.tobytes() for s in shingler.sets(texts)]}

    return map_texts(docs, [StructField("grams", BinaryType())], make, text, keep)


def _verify(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of the classes in one cell: how many documents each is linked with, and the least class it is joined to."""
    limit = Fraction(threshold).limit_denominator(1000)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("cid", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in cell["grams"]]
        sizes, m = np.array([len(s) for s in sets]), len(cell)
        _, names, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows, shared = np.repeat(np.arange(m), sizes), counts[names] > 1
        order = np.cumsum(counts > 1) - 1
        rows, names, total = rows[shared], order[names[shared]], int((counts > 1).sum())
        meet = np.zeros((m, m), np.float32)
        for a in range(0, total, 4096):
            inside = (names >= a) & (names < a + 4096)
            part = np.zeros((m, min(4096, total - a)), np.float32)
            part[rows[inside], names[inside] - a] = 1
            meet += part @ part.T
        meet = np.rint(meet).astype(np.int64)
        linked = meet * limit.denominator >= (sizes[:, None] + sizes[None, :] - meet) * limit.numerator
        np.fill_diagonal(linked, False)
        block, (one, other) = cell["block"].to_numpy(), cell[["low", "high"]].iloc[0]
        if one != other:
            linked &= block[:, None] != block[None, :]
        held = np.stack([np.asarray(b) for b in cell["bands"]])
        same = lambda b: held[:, b][:, None] == held[:, b][None, :]
        if cell["bucket"].iloc[0]:  # a pair counts in the first band that it shares
            for b in range(int(np.flatnonzero(held[0] == cell["cell"].iloc[0])[0])):
                linked &= ~same(b)
        else:
            linked &= np.logical_or.reduce([same(b) for b in range(held.shape[1])])
        root = list(range(m))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            a, b = sorted((find(int(i)), find(int(j))))
            root[b] = a
        cids = cell["cid"].to_numpy()
        out = pd.DataFrame({"cid": cids, "links": linked @ cell["n"].to_numpy(), "joined": [cids[find(i)] for i in range(m)]})
        return out[out["links"] > 0]

    return run


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, group: str | None = None, whole_group: int = WHOLE_GROUP) -> DataFrame:
    """Adds class_id and n_links, and copies, to each row.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is at least `threshold` and their
    signatures agree in a band; n_links
    counts a row's links, repeated rows and exact copies included. class_id is the least id among all documents that
    links connect; copies is the number of rows with the same set. Texts shorter than n words are one n-gram. Null,
    empty and wordless texts are linked with nothing and are their own class. Null ids take part, yet name a class
    only if no other id does. Of pairs at the threshold `recall` agree in a band, of more similar ones more. Very long
    texts are one set of n-grams in memory. Input columns named like an added one give way. `group` names one more column: a key of the group that links connect, its own also
    where ids are null or repeat, null for wordless texts.
    """
    bands, per_band = choose_bands(threshold, recall)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("class_id", "n_links", "copies", (group or "class_id").lower())]
    id_text = docs.select(plain(doc_id).alias("id"), plain(text).alias("text"), F.xxhash64(plain(text)).alias("hash"))
    signed = written(_signed(id_text, width, bands, per_band, "text", ["id", "hash"]), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    by_set = signed.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), first.alias("first"), F.any_value("bands").alias("bands"))
    classes = written(by_set.select(F.monotonically_increasing_id().alias("cid"), "digest", "n", F.col("first.id").alias("id"), F.col("first.hash").alias("hash"), "bands"), "classes")

    spread = classes.select("cid", F.explode("bands").alias("bucket"))
    buckets = written(spread.groupBy("bucket").agg(F.min("cid").alias("least"), F.count("*").alias("held")).filter("held > 1"), "buckets")
    members = written(join_hot(spread, buckets, "bucket", "held"), "members")
    # Each class hooks to the least class it meets, and the others that it meets hook to that one as well: the same
    # components from far fewer edges, as the classes of a large group meet the same few.
    hooked = members.withColumn("hook", F.min("least").over(Window.partitionBy("cid")))
    edges = hooked.select(F.col("cid").alias("a"), F.col("hook").alias("b")).union(hooked.select(F.col("least"), F.col("hook")))
    groups = components(edges.filter("a <> b").distinct())
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    grouped = written(join_hot(groups, written(sizes, "sizes"), "root", "size").select(F.col("node").alias("cid"), "root", "size"), "grouped")

    def cells(rows: DataFrame, key: str, size: str, bucket: bool) -> DataFrame:
        """Each class in its block, met with every block of the same key once."""
        blocks = F.ceil(F.col(size) / BLOCK)
        placed = rows.withColumn("block", F.pmod(F.xxhash64("cid"), blocks)).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        return placed.select(F.col(key).alias("cell"), F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), "block", "cid", F.lit(bucket).alias("bucket"))

    small, large = grouped.filter(F.col("size") <= whole_group), grouped.filter(F.col("size") > whole_group)
    placed = cells(small, "root", "size", False)
    if large.limit(1).count():
        placed = placed.union(cells(members.join(large.select("cid"), "cid"), "bucket", "held", True))
    wanted = classes.join(grouped.select("cid"), "cid")
    texts = id_text.join(wanted.select("cid", "id", "hash", "n", "bands"), id_text["id"].eqNullSafe(wanted["id"]) & (id_text["hash"] == wanted["hash"])).select("cid", "n", "bands", "text")
    grams = written(_with_sets(texts, width, "text", ["cid", "n", "bands"]).dropDuplicates(["cid"]), "grams")
    found = written(placed.join(grams, "cid").groupBy("cell", "low", "high", "bucket").applyInPandas(_verify(threshold), "cid long, links long, joined long"), "found")

    joined = components(found.filter("cid <> joined").select(F.col("cid").alias("a"), F.col("joined").alias("b")).distinct())
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = classes.select("cid", "digest", "n", "id").join(joined.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    per_class = written(rooted.join(names, "root").join(links, "cid", "left").select("digest", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("n").alias("copies")), "per-class")

    # Texts without words need no join; copies of one text may be a third of all rows.
    wordless = signed.filter("digest is null").withColumns({"root": F.lit(None).cast("long"), "class_id": F.col("id"), "n_links": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    out = join_hot(signed.filter("digest is not null"), per_class, "digest", "copies").unionByName(wordless)
    answer = ["class_id", "n_links", "copies", *([F.col("root").alias(group)] if group else [])]
    if [c.lower() for c in kept] == [doc_id.lower()]:
        return out.select(F.col("id").alias(doc_id), *answer)
    facts = out.select("id", "hash", *answer).dropDuplicates(["id", "hash"])
    whole = docs.select(*map(plain, kept), plain(doc_id).alias("__id"), F.xxhash64(plain(text)).alias("__hash"))
    return whole.join(facts, whole["__id"].eqNullSafe(facts["id"]) & (whole["__hash"] == facts["hash"])).select(*map(plain, kept), "class_id", "n_links", "copies", *([group] if group else []))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents with one of each group of near duplicates: the one of least id. Of a group's rows that share this id,
    or have none at all, any one stays; groups are told apart also where ids are null or repeat. Texts without words all
    stay."""
    names = docs.columns
    found = near_duplicates(docs, text=text, doc_id=doc_id, group="__group", **options).filter(plain(doc_id).eqNullSafe(F.col("class_id")))
    wordless = F.col("__group").isNull()
    return found.filter(wordless).unionByName(found.filter(~wordless).dropDuplicates(["__group"])).select(*map(plain, names))
