"""Packing into windows with few cuts: best-fit decreasing over a segment tree of remaining capacities.

Overlong documents are cut into full windows first. What is left of each document goes, longest first, to the tightest
open window that takes it. Windows that would still be padded by more than a small gap are then closed with cut pieces:
the emptiest ones are handed out to fill the others, and the last one is parted into lengths that need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from millrace.llm.packing import token_pieces
from millrace.llm.texts import plain
from millrace.sources.tables import written

CAPACITY = 2048
#: Gaps up to this part of a window are padded rather than filled with a cut piece.
LEAST_GAP = 1 / 128
#: Short pieces that a partition packs at once, about.
PIECES_PER_PARTITION = 4096


class OpenWindows:
    """Open windows in a segment tree by remaining capacity: each node holds how many windows are below it."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, change: int) -> None:
        at, held = self.size + room, self.held
        while at:
            held[at] += change
            at >>= 1

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The (window, room) of the least room that is `need` or more, which is open no longer; None if there is none."""
        at, held = self.size + need, self.held
        if not held[at]:
            while at > 1 and (at & 1 or not held[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                at += not held[at]
        room = at - self.size
        self._count(room, -1)
        return self.windows[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The pieces of each window. Longest first, ties by place; each goes to the tightest open window, else to a new one."""
    tree, windows = OpenWindows(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if found := tree.take(need):
            window, room = found
            windows[window].append(i)
        else:
            window, room = len(windows), capacity
            windows.append([i])
        if room > need:
            tree.add(room - need, window)
    return windows


def is_unpadded(length: int, capacity: int) -> bool:
    return length == capacity or length & (length - 1) == 0


def close_gaps(windows: list[list[tuple[int, int, int]]], capacity: int, least_gap: int) -> list[list[tuple[int, int, int]]]:
    """Windows of parts (piece, start, length) with the same ids in all, none padded by more than `least_gap`.

    The fullest open window is filled from the emptiest one, by whole parts where they fit and by the head of one
    where they don't. The last open window is parted into powers of two. Each window costs one cut at most, but for the last.
    """
    fill = [sum(p[2] for p in w) for w in windows]
    wide = [i for i, f in enumerate(fill) if capacity - f > least_gap and not is_unpadded(f, capacity)]
    wide.sort(key=lambda i: (-fill[i], i))
    full, empty = 0, len(wide) - 1
    while full < empty:
        to, giver = windows[wide[full]], windows[wide[empty]]
        gap = capacity - fill[wide[full]]
        piece, start, length = giver.pop()
        taken = min(gap, length)
        to.append((piece, start, taken))
        if length > taken:
            giver.append((piece, start + taken, length - taken))
        fill[wide[full]] += taken
        fill[wide[empty]] -= taken
        full += fill[wide[full]] == capacity
        empty -= not fill[wide[empty]]
    out = [w for i, w in enumerate(windows) if w and not (full == empty and i == wide[full])]
    if full == empty and (rest := windows[wide[full]]):
        left = fill[wide[full]]
        if capacity - left <= least_gap or is_unpadded(left, capacity):
            return [*out, rest]
        rest = rest[::-1]
        while left:
            room, part = 1 << left.bit_length() - 1, []
            left -= room
            while room:
                piece, start, length = rest.pop()
                taken = min(room, length)
                part.append((piece, start, taken))
                room -= taken
                if length > taken:
                    rest.append((piece, start + taken, length - taken))
            out.append(part)
    return out


def _checked(parts: DataFrame) -> DataFrame:
    """Parts of pieces with the checksum of their own ids, which it takes out."""
    names = parts.drop("ids", "__skip").columns
    out = StructType([parts.schema[n] for n in names])
    at = {n: parts.columns.index(n) for n in parts.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in batches:
            own = batch.column(at["ids"])
            ids, begins = own.flatten().to_numpy().astype("<u4"), own.offsets.to_numpy() - own.offsets[0].as_py()
            skip, length = (batch.column(at[n]).to_numpy() for n in ("__skip", "length"))
            crc = pa.array([zlib.crc32(ids[b + s : b + s + n].tobytes()) for b, s, n in zip(begins, skip, length, strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([crc if n == "ids_crc32" else batch.column(at[n]) for n in names], schema=schema)

    return parts.mapInArrow(run, out)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", keep: list[str] | None = None, least_gap: float = LEAST_GAP, per_partition: int = PIECES_PER_PARTITION, lasting: bool = False, most_broadcast: int = 1_000_000) -> DataFrame:
    """A row for each piece of a document: the kept columns, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's tokens are those of its whole text and `end_id`; null and empty texts have that one. Each token lies in
    one piece. Repeated rows and null ids are packed as often as they come; ties of length keep the order of their
    partition; no documents give no rows. An input column named like an added one (piece and ids too) gives way. Full
    windows of overlong documents are not shuffled; short pieces are dealt evenly, whatever document they are of. Ids are
    written once and read again only for the pieces that were cut, which are broadcast up to a counted `most_broadcast`.
    """
    added = {"piece", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset", "__row", "__skip", "__cut"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    pieces = token_pieces(docs, tokenizer, capacity, end_id, text, kept, short_ids=True, lasting=lasting).drop("piece")
    pieces = written(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(F.col("length") < capacity).drop("ids")
    places = [StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("__skip", LongType()), StructField("__cut", BooleanType())]
    out = StructType([*short.schema.fields, *places])
    names, most = short.columns, int(capacity * least_gap)
    at = {n: names.index(n) for n in ("start", "length")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, got = to_arrow_schema(out), list(batches)
        if not got:
            return
        mine = pa.Table.from_batches(got)
        lengths = mine.column(at["length"]).to_numpy().astype(np.int64)
        windows = close_gaps([[(i, 0, int(lengths[i])) for i in w] for w in best_fit(lengths, capacity)], capacity, most)
        first, rows = TaskContext.get().partitionId() << 32, []
        for number, window in enumerate(windows):
            offset = 0
            for piece, start, length in window:
                rows.append((piece, start, length, first + number, offset))
                offset += length
        piece, start, length, number, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        values = {n: mine.column(i).take(pa.array(piece)) for i, n in enumerate(names) if n not in at}
        values |= {"start": pa.array(mine.column(at["start"]).to_numpy()[piece] + start), "length": pa.array(length), "sequence_id": pa.array(number), "offset": pa.array(offset), "__skip": pa.array(start), "__cut": pa.array(length < lengths[piece])}
        yield from pa.Table.from_arrays([values[f.name] for f in out.fields], schema=schema).to_batches(max_chunksize=10_000)

    packed = written(short.repartition(max(1, -(-short.count() // per_partition))).mapInArrow(run, out), "packed")
    result = [*kept, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = packed.filter("__cut")
    few = F.broadcast(cut) if cut.count() <= most_broadcast else cut
    checked = _checked(pieces.select("__row", "ids").join(few, "__row"))
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("__row")).withColumn("offset", F.lit(0).cast("long"))
    parts = [f.select(*map(plain, result)) for f in (packed.filter("not __cut"), checked, full)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
