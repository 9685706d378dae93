"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Each partition packs its pieces by best-fit decreasing, or fills by pairs where that takes fewer sequences, and compares
their number with the best of its dual-feasible-function bounds. A partition that meets its bound is certified: no packing of its own pieces is better, so
that all it still gives away is its emptiest sequence. A partition with a gap gives all sequences that are not full. What
is given goes to other partitions and is packed anew, until the total meets the bound over all pieces or an exchange
saves nothing.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from millrace.llm.texts import json_word_tokens, lasting_word_tokens, map_texts
from millrace.sources.tables import written

#: Pieces that a partition packs at once, about; a piece is a row of some 60 bytes here.
PIECES_PER_PARTITION = 4096


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", keep: list[str] | None = None, short_ids: bool = False, lasting: bool = False) -> DataFrame:
    """A row for each piece of at most `capacity` ids of a whole text and `end_id`.

    Null and empty texts have the one id `end_id`, and texts of any length give pieces to their end. Repeated rows are packed as often as they come. Adds piece, start,
    length, ids_crc32 and, with `short_ids`, doc_tokens and the ids of pieces below the capacity; an input column of these names gives way.
    """
    fields = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    fields += [StructField("doc_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))] if short_ids else []

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = (lasting_word_tokens if lasting else json_word_tokens)(tokenizer)

        def cut(texts: pa.Array) -> dict:
            ids, ends = tokens(texts)
            out: dict[str, list] = {f.name: [] for f in fields} | {"row": []}
            at = 0
            for row, end in enumerate(ends.tolist()):
                own = np.append(ids[at:end], end_id).astype("<u4")
                at = end
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    for name, value in (("row", row), ("piece", piece), ("start", start), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                        out[name].append(value)
                    if short_ids:
                        out["doc_tokens"].append(len(own))
                        out["ids"].append(part.astype(np.int32) if len(part) < capacity else None)
            return out

        return cut

    return map_texts(docs, fields, make, text, keep, form="arrow", explode=True)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that pieces need at least; counts[x] pieces have length x, up to the capacity.

    The largest of the plain volume bound, the bounds that count pieces over capacity - k as one and drop those
    under k, and the step functions u(k), all of them dual feasible.
    """
    x = np.arange(capacity + 1)
    if not counts.sum():
        return 0
    volume, number = np.cumsum(counts * x), np.cumsum(counts)
    best = -(-int(volume[-1]) // capacity)
    k = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    middle = volume[capacity - k] - volume[k - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        steps = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * steps).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each piece, and the fill of each bin. A piece goes to the fullest bin that takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if fits := rooms >> need:
            room = need + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = chosen, capacity - room
        fill[chosen] += need
        if left := room - need:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, np.asarray(fill, np.int64)


def fill_by_pairs(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_fit_decreasing: each bin gets the longest piece left, then pairs, or single pieces, that fill its room best.

    It is the better of the two where pieces are about a third or a quarter of a sequence.
    """
    left, sizes = np.bincount(lengths, minlength=capacity + 1), np.arange(capacity + 1)
    own = [list(x) for x in np.split(np.argsort(lengths, kind="stable"), np.cumsum(left)[:-1])]
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    last = capacity
    while True:
        while last and not left[last]:
            last -= 1
        if not last:
            return bins, offsets, np.asarray(fill, np.int64)
        at, chosen = 0, [last]
        while chosen:
            for size in chosen:
                piece = own[size].pop()
                bins[piece], offsets[piece] = len(fill), at
                left[size] -= 1
                at += size
            near = np.maximum.accumulate(np.where(left > 0, sizes, 0))[: capacity - at + 1]  # the longest piece up to each size
            one = np.flatnonzero(left[: capacity - at + 1])
            if not len(one):
                break
            two = near[capacity - at - one]
            again = (two == one) & (left[one] < 2)
            two[again] = near[one[again] - 1]
            best = int(np.argmax(one + two))
            chosen = [int(x) for x in (one[best], two[best]) if x]
        fill.append(at)


def _round(pieces: DataFrame, capacity: int, number: int, per_partition: int, rows: int) -> DataFrame:
    """Packs each of evenly dealt partitions by itself. gives says whether a piece's sequence takes part in an exchange."""
    pieces = pieces.drop("sequence_id", "offset", "gives")
    fields = [StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("gives", BooleanType())]
    out = StructType([*pieces.schema.fields, *fields])
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, got = to_arrow_schema(out), list(batches)
        if not got:
            return
        mine = pa.Table.from_batches(got)
        lengths = mine.column(at).to_numpy().astype(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if len(fill) > bound and len((other := fill_by_pairs(lengths, capacity))[2]) < len(fill):
            bins, offsets, fill = other
        certified = len(fill) == bound
        gives = np.arange(len(fill)) == int(np.argmin(fill)) if certified else fill < capacity
        first = (number << 56) + (TaskContext.get().partitionId() << 28)
        table = pa.Table.from_arrays([*mine.columns, *map(pa.array, (first + bins, offsets, (gives & (fill < capacity))[bins]))], schema=schema)
        yield from table.to_batches(max_chunksize=10_000)

    return pieces.repartition(max(1, -(-rows // per_partition))).mapInArrow(run, out)


def pack(pieces: DataFrame, capacity: int = 4096, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` from 1 to `capacity`; an input column of these names, or `gives`, goes.

    No pieces give no rows. Pieces of equal length are interchangeable; ties go to the first in the partition. Each
    exchange saves a sequence or is the last, and partitions that are certified give one sequence each, so that exchanges
    soon have few pieces. Where an exchange saves nothing, the packing before it stays.
    """
    pieces = written(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[length] = n
    bound = lower_bound(counts, capacity)
    packed, done = written(_round(pieces, capacity, 0, per_partition, int(counts.sum())), "packed"), []
    total, number = packed.filter("offset = 0").count(), 0
    while total > bound:
        given = packed.filter("gives")
        rows, before = given.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if before < 2:
            break
        number += 1
        again = written(_round(given, capacity, number, per_partition, rows), "packed")
        saved = before - again.filter("offset = 0").count()
        if saved <= 0:
            break
        done.append(packed.filter("not gives"))
        packed, total = again, total - saved
    for part in done:
        packed = packed.unionByName(part)
    return packed.drop("gives")
