"""Removal of passages that repeat across documents, by chunks of whole lines, in DataFrame functions alone.

Rolling hashes over the hashes of neighbouring lines choose boundaries: in each least run of whole lines with enough words,
the place of the least rolling hash. The choice depends on the run's own lines alone, so that it shifts with them, and runs
with the same lines have the same boundary. Boundaries that stand at one place only go first, with all their chunks. The
chunks around the others are the runs themselves; every line begins one and ends one, so that no edge of a passage falls
between chunks, which parts of a text between two boundaries would have. Those that occur again are joined to runs of
lines, and runs are compared with their first place byte for byte before they go. Lines without words are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.texts import plain
from millrace.sources.tables import join_hot, written

#: Words in a run of repeated lines from which on it is removed.
LEAST_WORDS = 50

# Blocks of scripts that write no spaces. A Chinese, Japanese or Korean character counts as a word; of the
# scripts of South-East Asia, four characters at most do.
_SINGLE = "\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff"
_FOURS = "\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff"
WORD = rf"[{_SINGLE}]|[{_FOURS}]{{1,4}}|[^\s{_SINGLE}{_FOURS}]+"

_KEY = ["id", "hash"]
_PLACE = ["first_id", "first_hash", "first_a", "first_e"]


def words_in(line: Column) -> Column:
    """Words between white space, and characters of scripts without spaces; 0 for a blank line.

    Where single spaces part the words, which is nearly always, the spaces are counted; the expression takes the rest.
    """
    uneven = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for sign in "\t\r\f\v":
        uneven = uneven | line.contains(sign)
    unspaced = (F.octet_length(line) > F.length(line)) & line.rlike(f"[{_SINGLE}{_FOURS}]")
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" ")))
    return F.when(line == "", 0).when(uneven | unspaced, F.regexp_count(line, F.lit(WORD))).otherwise(spaces + 1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, least_words: int) -> DataFrame:
    """A row for each chunk: the places of its first and last line, a and e, the number k of its first line among those
    with words, its hash h, and its boundary: the least rolling hash of two lines in a row in it (of its line, if it has
    but one) and where that first stands, b. Bytes are compared later, so that 64 bits are enough."""
    n = max(1, least_words)

    def line(x: Column, i: Column) -> Column:
        return F.struct(F.least(words_in(x), F.lit(n)).alias("w"), F.xxhash64(x).alias("h"), i.alias("i"))

    step = docs.select(*_KEY, F.filter(F.transform(lines_of(F.col("text")), line), lambda x: x["w"] > 0).alias("facts"))
    # The line of each word, of n words a line at most: a chunk is the lines of n words in a row.
    names = F.transform("facts", lambda x: x["h"])
    step = step.select(*_KEY, "facts", names.alias("names"), F.flatten(F.transform("facts", lambda x, i: F.array_repeat(i, x["w"]))).alias("p"))
    held = F.greatest(F.size("p") - n + 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice("p", 1, held), F.slice("p", n, held), lambda a, e: F.shiftleft(a.cast("long"), 32) + e))
    rolled = F.zip_with("names", F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    step = step.select(*_KEY, "facts", "names", rolled.alias("rolled"), F.when(held > 0, pairs).alias("pairs"))

    def window(x: Column) -> Column:
        a, e = F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        own = F.slice("names", a + 1, e - a + 1)
        place = lambda at: F.get("facts", at)["i"]
        least = F.when(a == e, F.get("names", a)).otherwise(F.array_min(F.slice("rolled", a + 1, e - a)))
        at = F.when(a == e, a).otherwise(a + F.array_position(F.slice("rolled", a + 1, e - a), least).cast("int") - 1)
        return F.struct(F.xxhash64(own).alias("h"), place(a).alias("a"), place(e).alias("e"), a.alias("k"), least.alias("boundary"), at.alias("b"))

    return step.select(*_KEY, F.inline_outer(F.transform("pairs", window))).filter("a is not null")


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers the groups of overlapping (a, e) among the rows of each key: column run."""
    order = Window.partitionBy(*keys).orderBy("a", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("apart", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("apart").over(order))


def bounded_chunks(rows: DataFrame) -> DataFrame:
    """The chunks whose boundary stands at two places or more. Each place counts once, so that copies of a row and chunks
    that share a boundary make none; what is shuffled to find out is a row for each boundary of a partition."""
    place = F.struct(*_KEY, "b")
    seen = rows.groupBy("boundary").agg(F.count("*").alias("held"), F.min(place).alias("least"), F.max(place).alias("most"))
    shared = written(seen.filter(~F.col("least").eqNullSafe(F.col("most"))).select("boundary", "held"), "boundaries")
    return join_hot(rows, shared, "boundary", "held").select(*_KEY, "h", "a", "e", "k")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs of lines, from a to e, whose chunks all stand first at first_a to first_e of one other place."""
    rows = written(bounded_chunks(written(_windows(docs, least_words), "windows")), "chunks")
    first = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "a", "e", "k")).alias("first"))
    repeated = written(first.filter("n > 1").select("h", "n", "first"), "repeated")
    met = join_hot(rows, repeated, "h", "n")
    met = met.filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash")) & (F.col("a") == F.col("first.a"))))
    places = [F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"), F.col("first.a").alias("first_a"), F.col("first.e").alias("first_e")]
    met = met.select(*_KEY, "a", "e", *places, (F.col("k") - F.col("first.k")).alias("lag"))
    keys = [*_KEY, "first_id", "first_hash", "lag"]
    bounds = [F.min("a").alias("a"), F.max("e").alias("e"), F.min("first_a").alias("first_a"), F.max("first_e").alias("first_e")]
    return _islands(met, keys).groupBy(*keys, "run").agg(*bounds).drop("lag", "run")


def _cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges (id, hash, a, e and a first place) with their text t, lines without words aside. A document is read
    once, with all its ranges."""
    held = ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("a", "e", *_PLACE)).alias("ranges")).select(F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), "ranges").hint("merge")
    whole = docs.join(held, docs["id"].eqNullSafe(held["own_id"]) & (docs["hash"] == held["own_hash"])).select("own_id", "own_hash", lines_of(F.col("text")).alias("lines"), "ranges")
    text = lambda r: F.array_join(F.filter(F.slice("lines", r["a"] + 1, r["e"] - r["a"] + 1), lambda x: x.rlike(r"\S")), "\n")
    return whole.select("own_id", "own_hash", F.inline(F.transform("ranges", lambda r: F.struct(*[r[c].alias(c) for c in ("a", "e", *_PLACE)], text(r).alias("t")))))


def _first_places(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("first_id").alias("id"), F.col("first_hash").alias("hash"), F.col("first_a").alias("a"), F.col("first_e").alias("e"), *_PLACE).distinct()


def differing(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The first places of runs with which some run does not agree byte for byte, lines without words aside.

    Equal texts become one in each partition before they are shuffled.
    """
    ranges = runs.select(*_KEY, "a", "e", *_PLACE).union(_first_places(runs))
    return _cut(docs, ranges).select(*_PLACE, "t").distinct().groupBy(*_PLACE).agg(F.count("*").alias("n")).filter("n > 1").select(*_PLACE)


def unlike(docs: DataFrame, runs: DataFrame, places: DataFrame) -> DataFrame:
    """The runs at these first places that do not agree with them byte for byte; hashes that clash lead here, no others."""
    other = places.select(*[F.col(c).alias(f"at_{c}") for c in _PLACE])
    doubted = written(runs.join(other, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in _PLACE], "left_semi").select(*_KEY, "a", "e", *_PLACE), "doubted")
    theirs = _cut(docs, _first_places(doubted)).select(*[F.col(c).alias(f"at_{c}") for c in _PLACE], F.col("t").alias("at_t")).distinct()
    met = _cut(docs, doubted).join(theirs, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in _PLACE])
    return met.filter("t <> at_t").select(F.col("own_id").alias("id"), F.col("own_hash").alias("hash"), "a", "e", *_PLACE).distinct()


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """For each document (id, hash) with something to remove: removed, the places of the first and last line, a and e, of
    the ranges that go, apart from each other and in order."""
    runs = written(repeated_runs(docs, least_words), "runs")
    wrong = written(differing(docs, runs), "differing")
    if wrong.limit(1).count():
        named = [*_KEY, "a", "e", *_PLACE]
        other = written(unlike(docs, runs, wrong), "unlike").select(*[F.col(c).alias(f"wrong_{c}") for c in named])
        runs = runs.join(other, [F.col(c).eqNullSafe(F.col(f"wrong_{c}")) for c in named], "left_anti")
    ranges = _islands(runs.select(*_KEY, "a", "e").distinct(), _KEY).groupBy(*_KEY, "run").agg(F.min("a").alias("a"), F.max("e").alias("e"))
    return ranges.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("a", "e"))).alias("removed"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = LEAST_WORDS, keep: list[str] | None = None) -> DataFrame:
    """The rows with repeated passages cut out of their texts, and n_removed_words.

    A passage is a run of whole lines, `least_words` words or more, that stands elsewhere too, byte for byte; blank lines
    between them do not matter and go with it. The place that stays is the first by id, then by the text's hash, then in
    the text; null ids come first. Repeated rows (same id and text) are one document and keep the same. All lines of a
    text may go, which leaves the empty text. Null texts stay null, empty and blank ones as they are, and shorter repeats
    stay. A very long text is one row with its lines. An input column n_removed_words gives way.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "n_removed_words"]
    gone = removed_lines(docs.select(plain(doc_id).alias("id"), F.xxhash64(plain(text)).alias("hash"), plain(text).alias("text")), least_words).hint("merge")
    whole = docs.select(*map(plain, kept), plain(doc_id).alias("__id"), F.xxhash64(plain(text)).alias("__hash"), plain(text).alias("__text"))
    met = whole.join(gone, whole["__id"].eqNullSafe(gone["id"]) & (whole["__hash"] == gone["hash"]), "left")
    lines = lines_of(F.col("__text"))
    # What stays lies between the end of one range and the beginning of the next.
    ends, begins = F.array_prepend(F.transform("removed", lambda r: r["e"]), F.lit(-1)), F.array_append(F.transform("removed", lambda r: r["a"]), F.size(lines))
    rest = F.array_join(F.flatten(F.zip_with(ends, begins, lambda e, a: F.slice(lines, e + 2, a - e - 1))), "\n")
    taken = F.flatten(F.transform("removed", lambda r: F.slice(lines, r["a"] + 1, r["e"] - r["a"] + 1)))
    n_taken = F.aggregate(taken, F.lit(0), lambda n, x: n + words_in(x))
    cleaned = F.when(F.col("removed").isNull(), F.col("__text")).otherwise(rest)
    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(n_taken).cast("long").alias("n_removed_words")
    return met.select(*[cleaned.alias(c) if c.lower() == text.lower() else plain(c) for c in kept], n_removed)
