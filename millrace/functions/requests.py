"""What a request names (paths, symbols, frames of a stack) and what it talks about, as columns.

All rules run on whole texts, over arrays of short runs, so that a very long run exhausts no regular expression. A null
text gives empty arrays and false flags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import tokens

# Endings by which a dotted name is a file.
SUFFIXES = tuple("py js jsx ts tsx mjs cjs go rs java rb c h cpp cs swift kt php vue svelte css scss sh md rst txt json toml yaml yml ini cfg html sql lock xml".split())
# Wording of the first sentence that asks for a kind of file.
WANTS = {
    "test": r"(?i)\b(?:tests?|testing|pytest|unittest|spec|coverage)\b",
    "doc": r"(?i)\b(?:docs?|documentation|readme|changelog|docstrings?|typos?)\b",
    "config": r"(?i)\b(?:config\w*|settings?|manifest|dependenc\w+|workflow|ci)\b",
}
# Frames of the two kinds of stack traces, as path, line and function.
PYTHON_FRAME = r'File "([^"\n]{1,400})", line (\d{1,7})(?:, in ([A-Za-z_][\w.<>]*))?'
SCRIPT_FRAME = r"\bat (?:([\w.$<>\[\] ]{1,120}?) \()?((?:[A-Za-z]:)?[^\s():]{1,400}\.(?:m?[jt]sx?|cjs|vue|svelte)):(\d{1,7})(?::\d+)?\)?"
URL = r"\b(?:https?|ssh|git)://\S+"
FIRST_SENTENCE = r"(?<=[.!?])\s+|\n\s*\n"
#: Words without a subject of their own. Callers with a longer list give theirs.
GENERIC = tuple("the and for with this that are was from not when what why how should would could add fix use make file code test".split())


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _while(items: Column, holds) -> Column:
    """The items before the first one that the condition fails."""
    stop = F.array_position(F.transform(items, holds), False)
    return F.when(stop == 0, items).otherwise(F.slice(items, 1, F.greatest(stop - 1, F.lit(0)).cast("int")))


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _file_part(piece: Column) -> Column:
    """The dotted name that a piece of a path begins with, or an empty text."""
    head = F.regexp_replace(F.substring_index(piece, "..", 1), r"\.$", "")
    return F.when(head.rlike(r"^[^.]+\."), head).otherwise(F.lit(""))


def _paths_of(run: Column) -> tuple[Column, Column]:
    """A run's name with slashes and its name that ends in a dotted file, each an empty text where there is none."""
    pieces = _while(F.split(run, "/"), lambda p: p != "")
    slashed = F.when(F.size(pieces) > 1, F.array_join(pieces, "/")).otherwise(F.lit(""))
    files = F.transform(pieces, _file_part)
    at = F.array_max(F.transform(files, lambda f, i: F.when(f != "", i)))
    filed = F.when(at.isNull(), F.lit("")).otherwise(F.array_join(F.concat(F.slice(pieces, F.lit(1), at), F.array(F.get(files, at))), "/"))
    return slashed, filed


def paths(text: Column) -> Column:
    """Names with a slash, then names with the ending of a file; distinct, without leading ./ and trailing dots."""
    runs = _all(text, r"[\w./@-]+")
    found = F.concat(F.transform(runs, lambda r: _paths_of(r)[0]), F.transform(runs, lambda r: _paths_of(r)[1]))
    bare = F.transform(found, lambda v: F.regexp_replace(v, r"^[./]*/|\.+$", ""))
    named = lambda v: v.contains("/") | (v.contains(".") & F.lower(_last(v)).isin(*SUFFIXES))
    return F.array_distinct(F.filter(bare, named))


def dotted(text: Column) -> Column:
    """Names of two identifiers or more joined by dots that don't end as a file does."""
    parts = F.transform(_all(text, r"[\w.]+"), lambda run: _while(F.split(run, r"\."), lambda p: p.rlike("^[A-Za-z_]")))
    several = lambda p: (F.size(p) > 1) & ~F.lower(F.element_at(p, -1)).isin(*SUFFIXES)
    long = lambda p: F.forall(p, lambda s: F.length(s) > 1) & F.exists(p, lambda s: F.length(s) > 2)
    return F.array_distinct(F.transform(F.filter(parts, lambda p: several(p) & long(p)), lambda p: F.array_join(p, ".")))


def calls(text: Column) -> Column:
    """Names right before a parenthesis, with what they are called on."""
    runs = F.filter(_all(text, r"[\w.]+\(?"), lambda r: r.endswith("(") & r.rlike("^[A-Za-z_]"))
    return F.transform(runs, lambda r: F.substring(r, F.lit(1), F.length(r) - 1))


def frames(text: Column, most: int = 12) -> Column:
    """Frames of a stack trace: path without drive and leading slash, line, function, kind and whether it is the innermost.

    At most the first `most` count, Python's before scripts'. Names such as <stdin> are no files.
    """
    def read(pattern: str, path: int, line: int, function: int, kind: str) -> Column:
        rows = F.arrays_zip(_all(text, pattern, path).alias("p"), _all(text, pattern, line).alias("l"), _all(text, pattern, function).alias("f"))
        return F.transform(rows, lambda r: F.struct(r["p"].alias("raw"), r["l"].cast("long").alias("line"), r["f"].alias("f"), F.lit(kind).alias("kind")))

    def cleaned(r: Column) -> Column:
        steps = F.split(F.regexp_replace(F.translate(r["raw"], "\\", "/"), "^[A-Za-z]:", ""), "/")
        name = F.when((r["f"] == "") | r["f"].contains("<"), None).otherwise(_last(r["f"]))
        kept = F.array_join(F.filter(steps, lambda s: ~s.isin("", ".", "..")), "/")
        return F.struct(kept.alias("path"), r["line"].alias("line"), name.alias("function"), r["kind"].alias("kind"))

    found = F.slice(F.concat(read(PYTHON_FRAME, 1, 2, 3, "python"), read(SCRIPT_FRAME, 2, 3, 1, "script")), 1, most)
    kept = F.filter(F.transform(found, cleaned), lambda r: (r["path"] != "") & ~r["path"].contains("<"))
    last = F.array_max(F.transform(kept, lambda r, i: F.when(r["kind"] == "python", i)))
    return F.transform(kept, lambda r, i: F.struct(r["path"].alias("path"), r["line"].alias("line"), r["function"].alias("function"), r["kind"].alias("kind"), (i == F.coalesce(last, F.lit(0))).alias("innermost")))


def _is_identifier(word: Column) -> Column:
    """Joined by underscores, with a capital inside, or capitals with digits."""
    camel = word.rlike("^.[A-Za-z0-9_]*[A-Z]") & word.rlike("[a-z]")
    return word.rlike("[^_]_+[^_]") | camel | (word.rlike("[A-Z]") & word.rlike("[0-9]") & ~word.rlike("[a-z]"))


def analysed(frame: DataFrame, text: str, generic: Sequence[str] = GENERIC) -> DataFrame:
    """Adds raw_tokens, paths, dotted, frames, symbols, qualified, identifiers, concepts, generic, phrases and wants_test,
    wants_doc, wants_config; columns of these names that the frame has are replaced."""
    whole, dull = F.coalesce(F.col(text), F.lit("")), list(generic)
    held = frame.withColumn("__t", F.regexp_replace(whole, URL, " "))
    t = F.col("__t")
    held = held.withColumns({"__w": tokens.identifiers(t), "__c": calls(t), "paths": paths(t), "frames": frames(t)})
    held = held.withColumn("dotted", F.filter(dotted(t), lambda d: ~F.array_contains("paths", d)))
    told = lambda n: (F.length(n) > 2) & ~F.lower(n).isin(*dull)
    spans = F.filter(_all(t, "`([^`\n]{2,120})`", 1), lambda s: s.rlike(f"^{tokens.IDENTIFIER}$") & ~F.lower(s).isin(*dull))
    called = F.filter(F.transform("__c", _last), told)
    framed = F.filter(F.transform("frames", lambda r: r["function"]), lambda n: told(n) & n.rlike(f"^{tokens.IDENTIFIER}$"))
    pair = lambda v: F.concat(F.element_at(F.split(v, r"\."), -2), F.lit("."), _last(v))
    owned = F.transform(F.filter("__c", lambda v: v.contains(".") & ~v.endswith(".")), pair)
    capital = F.filter("dotted", lambda v: (F.size(F.split(v, r"\.")) > 2) & _last(v).rlike("^[A-Z]"))
    held = held.withColumns({
        "symbols": F.array_distinct(F.concat(called, spans, framed)),
        "qualified": F.array_distinct(F.concat(owned, F.transform(capital, pair))),
        "identifiers": F.array_distinct(F.filter("__w", _is_identifier)),
    })
    named = F.concat(F.col("symbols"), F.col("identifiers"), F.flatten(F.transform("dotted", lambda d: F.split(d, r"\."))))
    held = held.withColumn("__n", named)
    rest = F.array_distinct(F.transform(F.filter("__w", lambda w: ~F.array_contains("__n", w) & (F.length(w) > 2)), F.lower))
    held = held.withColumn("__r", rest)
    quoted = F.transform(_all(t, "[`\"']([^`\"'\n]{6,160})[`\"']", 1), F.trim)
    lead = F.get(F.split(F.trim(t), FIRST_SENTENCE, 2), F.lit(0))
    return held.withColumns({
        "raw_tokens": F.size("__w"),
        "concepts": F.filter("__r", lambda w: ~w.isin(*dull)),
        "generic": F.filter("__r", lambda w: w.isin(*dull)),
        "phrases": F.filter(quoted, lambda p: ~p.rlike(f"^{tokens.IDENTIFIER}$") & ~F.array_contains("paths", p)),
        **{f"wants_{kind}": lead.rlike(pattern) for kind, pattern in WANTS.items()},
    }).drop("__t", "__w", "__c", "__n", "__r")


def planned(analysis: DataFrame, text: str, history: str, impact: str) -> DataFrame:
    """Adds the reasons for a plan and its profile, a label for reading results and no permission. `history` and `impact`
    are patterns of wording."""
    some = lambda *names: F.greatest(*[F.size(n) for n in (*names, names[0])]) > 0
    whole = F.coalesce(F.col(text), F.lit(""))
    named = {
        "explicit_path": some("paths"), "traceback_frames": some("frames"), "qualified_name": some("dotted", "qualified"),
        "identifier": some("symbols", "identifiers"), "quoted_literal": some("phrases"),
    }
    none = ~F.greatest(*named.values())
    rules = {
        **named, "concept_terms_only": none & some("concepts"), "no_usable_terms": none & ~some("concepts"),
        "asks_for_tests": F.col("wants_test"), "history_wording": whole.rlike(history), "impact_wording": whole.rlike(impact),
    }
    reasons = F.filter(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()]), lambda r: r.isNotNull())
    has = lambda *names: F.arrays_overlap("reasons", F.array(*map(F.lit, names)))
    profile = F.when(has("explicit_path", "traceback_frames", "qualified_name", "quoted_literal"), "exact")
    for label, names in (("history", ["history_wording"]), ("impact", ["impact_wording"]), ("tests", ["asks_for_tests"]), ("behavior", ["identifier", "concept_terms_only"])):
        profile = profile.when(has(*names), label)
    return analysis.withColumn("reasons", reasons).withColumn("profile", profile.otherwise("vague"))
