"""Line differences of two versions of texts: changes, hunks, and the definitions that changes touch.

Lines that are in both versions once are anchors; the longest run of them that keeps its order stays. Between anchors the
longest common subsequence decides. It is found row by row with one bit for each line of the other side, and by halving
where the lines are many, so that memory grows with the lines and not with their product.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from millrace.operators.packets import prefix_sums

#: Cells up to which a gap has a plain table.
SMALL = 2048
#: Bytes that the remembered places of lines may have in all.
REMEMBERED = 64 << 20


def rising(places: list[int]) -> list[int]:
    """The indexes of a longest rising subsequence of distinct numbers; of several, the one with the least numbers at its ends."""
    ends, at, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        before.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [p], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a and each head of b, the empty one first."""
    m, where = len(b), {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    every, kept, masks = (1 << m) - 1, len(where) * (m // 8) <= REMEMBERED, {}
    v = every
    for x in a:
        if (mask := masks.get(x)) is None:
            held = bytearray(m // 8 + 1)
            for j in where.get(x, ()):
                held[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(held, "little")
            if kept:
                masks[x] = mask
        u = v & mask
        v = ((v + u) | (v - u)) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _table(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    rest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rest[i][j] = rest[i + 1][j + 1] + 1 if a[i] == b[j] else max(rest[i + 1][j], rest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rest[i + 1][j] >= rest[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of a and b."""
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        left, right = set(a[a0:a1]), set(b[b0:b1])
        own = [i for i in range(a0, a1) if a[i] in right]
        other = [j for j in range(b0, b1) if b[j] in left]
        if not own:
            continue
        if len(own) * len(other) <= SMALL or len(own) == 1:
            out += [(own[i], other[j]) for i, j in _table([a[i] for i in own], [b[j] for j in other])]
            continue
        half = len(own) // 2
        x, y = [a[i] for i in own], [b[j] for j in other]
        cut = int(np.argmax(_row(x[:half], y) + _row(x[:half - 1 : -1], y[::-1])[::-1]))
        middle_a, middle_b = own[half], other[cut] if cut < len(other) else b1
        todo += [(a0, middle_a, b0, middle_b), (middle_a, a1, middle_b, b1)]
    return sorted(out)


def aligned(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places (old, new) of the lines that stay, rising in both."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in side] for side in (old, new))
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = (len(a) - tail, len(b) - tail)
    many = [Counter(side[head:end]) for side, end in zip((a, b), ends, strict=True)]
    place = {y: j for j, y in enumerate(b[head : ends[1]], head) if many[0][y] == many[1][y] == 1}
    once = [(i, place[x]) for i, x in enumerate(a[head : ends[0]], head) if x in place]
    anchors = [once[k] for k in rising([j for _, j in once])]
    out, at = [(i, i) for i in range(head)], (head, head)
    for i, j in [*anchors, ends]:
        out += [(at[0] + x, at[1] + y) for x, y in longest_common(a[at[0] : i], b[at[1] : j])]
        if (i, j) != ends:
            out.append((i, j))
        at = (i + 1, j + 1)
    return out + [(ends[0] + k, ends[1] + k) for k in range(tail)]


def changed_runs(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old_from, old_to, new_from, new_to), from 0 and half open, of what lies between lines that stay."""
    out, i, j = [], 0, 0
    for x, y in [*aligned(old, new), (len(old), len(new))]:
        if (i, j) != (x, y):
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


_NUMBERS = ("change_no", "old_from", "old_to", "new_from", "new_to", "before", "after")
_LINES = ("lead", "removed", "added", "trail")


def line_changes(pairs: DataFrame, old: str, new: str, context: int | None = None) -> DataFrame:
    """A row for each change between two texts: the other columns, change_no from 1, its lines from 0 and half open, and how
    many equal lines are before and after it, up to the next change.

    With `context`, the lines as well: removed and added, lead (all equal lines before if a hunk with so much context has
    them, else the last `context`) and trail. A null text has no lines, an empty one has one; equal texts give no rows.
    Texts are compared whole. Repeated rows are each compared; an input column named like an added one gives way.
    """
    names = (*_NUMBERS, *(_LINES if context is not None else ()))
    kept = [c for c in pairs.columns if c.lower() not in {*names, old.lower(), new.lower()}]
    frame = pairs.select(*kept, F.col(old).cast("string").alias("__old"), F.col(new).cast("string").alias("__new"))
    fields = [StructField(n, IntegerType() if n in _NUMBERS else ArrayType(StringType())) for n in names]
    out = StructType([*frame.schema.fields[:-2], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, n = to_arrow_schema(out), len(kept)
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (lines_of(batch.column(n + k)[row].as_py()) for k in (0, 1))
                runs = changed_runs(a, b)
                if not runs:
                    continue
                got: dict[str, list] = {f: [] for f in names}
                ends = [(0, 0), *((r[1], r[3]) for r in runs)]
                starts = [*((r[0], r[2]) for r in runs[1:]), (len(a), len(b))]
                for k, (i0, i1, j0, j1) in enumerate(runs):
                    before, after = i0 - ends[k][0], starts[k][0] - i1
                    for f, value in zip(_NUMBERS, (k + 1, i0, i1, j0, j1, before, after), strict=True):
                        got[f].append(value)
                    if context is not None:
                        lead = before if k and before <= 2 * context else min(before, context)
                        for f, value in zip(_LINES, (a[i0 - lead : i0], a[i0:i1], b[j0:j1], a[i1 : i1 + min(after, context)]), strict=True):
                            got[f].append(value)
                own = [pa.repeat(batch.column(i)[row], len(runs)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(own)] + [pa.array(got[f], schema.field(n + i).type) for i, f in enumerate(names)], schema=schema)

    return frame.mapInArrow(run, out)


def hunks(pairs: DataFrame, key: list[str], old: str, new: str, context: int = 3, most: int | None = None, most_lines: int | None = None) -> DataFrame:
    """(key, hunk_no, old_from, old_to, new_from, new_to, lines, truncated): changes with `context` equal lines around them.

    Changes whose contexts touch are one hunk; lines begin with a space, - or +. Ranges count from 1 and include their ends, so
    that an empty one ends before it begins. The first `most` hunks of a pair are kept whole up to `most_lines` lines each;
    truncated says that lines are missing. The key tells pairs apart.
    """
    changes = line_changes(pairs.select(*key, old, new), old, new, context)
    order = Window.partitionBy(*key).orderBy("change_no")
    starts = (F.col("change_no") == 1) | (F.col("before") > 2 * context)
    numbered = changes.withColumn("hunk_no", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    numbered = numbered if most is None else numbered.filter(F.col("hunk_no") <= most)
    signed = lambda sign, name: F.transform(F.col(name), lambda x: F.concat(F.lit(sign), x))
    part = F.struct("change_no", F.concat(signed(" ", "lead"), signed("-", "removed"), signed("+", "added")).alias("lines"))
    first = lambda name: F.min_by(name, "change_no")
    last = lambda name: F.max_by(name, "change_no")
    ahead, behind = F.least(first("before"), F.lit(context)), F.least(last("after"), F.lit(context))
    own = numbered.groupBy(*key, "hunk_no").agg(
        (first("old_from") - ahead + 1).alias("old_from"), (last("old_to") + behind).alias("old_to"), (first("new_from") - ahead + 1).alias("new_from"), (last("new_to") + behind).alias("new_to"),
        F.concat(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["lines"])), F.transform(last("trail"), lambda x: F.concat(F.lit(" "), x))).alias("lines"),
    )
    if most_lines is None:
        return own.withColumn("truncated", F.lit(False))
    return own.withColumn("truncated", F.size("lines") > most_lines).withColumn("lines", F.slice("lines", 1, most_lines))


def owned_runs(spans: list[tuple[str, str, int, int]]) -> list[tuple[int, tuple[str, str] | None]]:
    """(first line, owner) of runs of lines with one innermost definition; spans (name, kind, start, end) include their ends."""
    marks = sorted({1, *(s[2] for s in spans), *(s[3] + 1 for s in spans)})
    order, out, open_, at = sorted(spans, key=lambda s: (s[2], -s[3], s[0], s[1])), [], [], 0
    for line in marks:
        while at < len(order) and order[at][2] <= line:
            open_.append(order[at])
            at += 1
        while open_ and open_[-1][3] < line:
            open_.pop()
        out.append((line, open_[-1][:2] if open_ else None))
    return out


def changed_definitions(pairs: DataFrame, old: str, new: str, old_spans: str, new_spans: str) -> DataFrame:
    """The other columns, name, kind and change: added, removed, or modified where a changed line is a definition's own.

    Spans are arrays of (name, kind, start, end), lines counted from 1, ends included, each inside another or apart from it. A
    line belongs to the innermost definition around it, so that a changed method doesn't change its class. Null spans are none.
    """
    kept = [c for c in pairs.columns if c.lower() not in {"name", "kind", "change", old.lower(), new.lower(), old_spans.lower(), new_spans.lower()}]
    span = "array<struct<name:string,kind:string,start:int,end:int>>"
    frame = pairs.select(*kept, *(F.col(c).cast(t).alias(f"__{i}") for i, (c, t) in enumerate(((old, "string"), (new, "string"), (old_spans, span), (new_spans, span)))))
    fields = [StructField(n, StringType()) for n in ("name", "kind", "change")]
    out = StructType([*frame.schema.fields[:-4], *fields])

    def touched(spans: list[tuple], changed: list[tuple[int, int]]) -> set:
        runs = owned_runs(spans)
        starts, got = [r[0] for r in runs], set()
        for a, b in changed:
            k = max(0, bisect_left(starts, a + 1) - 1)
            while k < len(runs) and runs[k][0] < b:
                got.add(runs[k][1])
                k += 1
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, n = to_arrow_schema(out), len(kept)
        for batch in batches:
            rows, names = [], []
            for row in range(batch.num_rows):
                before, after, *both = (batch.column(n + k)[row].as_py() for k in range(4))
                was, now = ([(s["name"], s["kind"], s["start"], s["end"]) for s in side or ()] for side in both)
                runs = changed_runs(lines_of(before), lines_of(after))
                hit = touched(was, [(r[0] + 1, r[1] + 1) for r in runs if r[1] > r[0]]) | touched(now, [(r[2] + 1, r[3] + 1) for r in runs if r[3] > r[2]])
                olds, news = {s[:2] for s in was}, {s[:2] for s in now}
                for d in sorted(olds | news):
                    if change := "added" if d not in olds else "removed" if d not in news else "modified" if d in hit else None:
                        rows.append(row)
                        names.append((*d, change))
            own = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(n)]
            yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(own)] + [pa.array([x[k] for x in names], pa.string()) for k in range(3)], schema=schema)

    return frame.mapInArrow(run, out)


def within_budget(commits: DataFrame, order: str, size: str, eligible: Column, most: int, most_bytes: int) -> DataFrame:
    """Adds state: ineligible, commit limit, byte limit or in.

    Eligible commits are taken by rising order (no ties) up to `most` of them and `most_bytes` in all; a null size is 0.
    Both sums are dealt by ranges, and nothing is read for a commit that is out.
    """
    able = F.coalesce(eligible, F.lit(False))
    rows = commits.withColumns({"__all": F.lit(0), "__one": able.cast("long"), "__size": F.when(able, F.coalesce(F.col(size), F.lit(0))).otherwise(0).cast("long"), "__able": able})
    counted = prefix_sums(rows, "__all", order, "__one").withColumnRenamed("used", "__n")
    summed = prefix_sums(counted.withColumn("__size", F.when(F.col("__n") <= most, F.col("__size")).otherwise(0)), "__all", order, "__size")
    state = F.when(~F.col("__able"), "ineligible").when(F.col("__n") > most, "commit limit").when(F.col("used") > most_bytes, "byte limit").otherwise("in")
    return summed.withColumn("state", state).drop("__all", "__one", "__size", "__able", "__n", "used")
