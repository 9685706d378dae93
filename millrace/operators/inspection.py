"""What a request names or asks for, and how answers and outside rankings meet a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.sources.tables import look_up, wide, written

from millrace.functions.tokens import SECRETS
from millrace.operators.resolve import modules

# Characters that carry a path on, punctuation around a word, and words that name no technology.
_PATH = r"[\p{L}\p{N}_./@~-]"
_AROUND = ".:!?()[]{}\"'`"
_PLAIN = "the and for with that this our my a an to of in on at by from is it why how what when we i me you your please can could".split()
OPERATIONS = ("symbols", "files", "relationships", "history", "snippet")


def phrase_hits(texts: DataFrame, key: str, phrases: DataFrame, block: int = 256) -> DataFrame:
    """(phrase_id, key) where a text (key, unique, and text) holds a phrase (phrase_id, phrase) verbatim.

    A phrase of three words or more has a whole word of its text inside: texts with the longest such word are tried. Shorter
    phrases are a query set that goes over all texts `block` at a time. Empty and null phrases or texts hit nothing.
    """
    words = F.split("phrase", " ")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    asked = phrases.filter("phrase <> ''").distinct().withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    held = texts.select(key, F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    near = held.join(asked.filter("word is not null"), "word").select("phrase_id", "phrase", key)
    hits = near.join(texts.select(key, "text"), key).filter(F.contains("text", "phrase")).select("phrase_id", key)
    short = asked.filter("word is null").select("phrase_id", "phrase")
    blocks = -(-short.count() // block)
    for i in range(blocks):
        some = short.filter(F.pmod(F.xxhash64("phrase_id", "phrase"), F.lit(blocks)) == i).collect()
        if some:
            tried = F.array(*[F.struct(F.lit(r.phrase_id).alias("phrase_id"), F.lit(r.phrase).alias("phrase")) for r in some])
            found = texts.select(key, F.explode(F.filter(tried, lambda p: F.contains(F.col("text"), p["phrase"]))).alias("p"))
            hits = hits.union(found.select("p.phrase_id", key))
    return hits


def explicit_paths(tasks: DataFrame, paths: DataFrame, project: str | None = None) -> DataFrame:
    """(task_id, path, line) for each path that the text of a task names, alone, after ./ or below the project's folder.

    A name ends where no letter, digit or one of _./@~- goes on, a full stop at the end of a sentence apart. The earliest
    mention counts, with its :line or #Lline if it has one. Names are looked up by the run of such characters they end in.
    """
    forms = [F.col("path"), F.concat(F.lit("./"), "path")] + ([F.concat(F.lit(project.rstrip("/") + "/"), "path")] if project else [])
    run = F.lit(_PATH + "+")
    named = paths.select("path").distinct().select("path", F.explode(F.array(*forms)).alias("form"))
    named = named.withColumn("run", F.element_at(F.regexp_extract_all("form", run, F.lit(0)), -1))
    runs = F.regexp_extract_all("text", run, F.lit(0))
    ends = F.array_distinct(F.concat(runs, F.transform(F.filter(runs, lambda r: r.endswith(".")), lambda r: F.substring(r, F.lit(1), F.length(r) - 1))))
    near = tasks.select("task_id", F.explode(ends).alias("run")).join(named, "run").select("task_id", "path", "form")
    quoted = F.concat(F.lit(r"\Q"), F.replace("form", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    whole = F.concat(F.lit(rf"(?<!{_PATH})"), quoted, F.lit(rf"(?:(?=\.(?:\s|\z))|(?!{_PATH}))(?:(?::|#L)([1-9][0-9]{{0,7}})(?![0-9]))?"))
    met = near.join(tasks.select("task_id", "text"), "task_id").withColumn("p", whole)
    seen = met.withColumn("at", F.regexp_instr("text", F.col("p"))).filter("at > 0").withColumn("line", F.call_function("regexp_extract", "text", "p", F.lit(1)).try_cast("int"))
    return seen.groupBy("task_id", "path").agg(F.min_by("line", "at").alias("line"))


def short_terms(text: Column) -> Column:
    """struct(terms, dropped): technology words fit for a public search, of the first eight that are left.

    Words are parted by white space, commas and semicolons. Those with other signs, five digits in a row or the shape of a
    secret are dropped and counted; everyday words go silently. A null text has no words.
    """
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,;]+"), lambda w: F.btrim(w, F.lit(_AROUND)))
    secret = lambda w: F.greatest(*[w.rlike(p) for p in SECRETS])
    odd = lambda w: ~w.rlike(r"\A[a-z][a-z0-9+#.-]{1,30}\z") | w.rlike("[0-9]{5}") | secret(w)
    given = F.filter(words, lambda w: w != "")
    good = F.filter(given, lambda w: ~odd(w) & ~w.isin(_PLAIN))
    return F.struct(F.array_join(F.array_distinct(F.slice(good, 1, 8)), " ").alias("terms"), F.size(F.filter(given, odd)).alias("dropped"))


def answered(requests: DataFrame, order: str) -> DataFrame:
    """Adds `state`: a request (session, op, value) of an unknown operation is rejected, one that was made before in its
    session is repeated, the first is run. The order is in
    the key of the join, so that a request made by a third of all rows is no hot key there."""
    first = requests.groupBy(F.col("session").alias("__s"), F.col("op").alias("__o"), F.col("value").alias("__v")).agg(F.min(order).alias("__first"))
    same = F.col("session").eqNullSafe(F.col("__s")) & F.col("op").eqNullSafe(F.col("__o")) & F.col("value").eqNullSafe(F.col("__v")) & (F.col(order) == F.col("__first"))
    known = F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)) & F.col("value").isNotNull()
    state = F.when(~known, "rejected").when(F.col("__first").isNotNull(), "run").otherwise("repeated")
    return requests.join(first, same, "left").withColumn("state", state).drop("__s", "__o", "__v", "__first")


def resolved_targets(targets: DataFrame, files: DataFrame, definitions: DataFrame) -> DataFrame:
    """(target, path, how): what a target stands for among files (path, module) and definitions (name, path).

    First the only path that is the target or ends in it at a slash, then a module of that name, then the only file that
    defines its last dotted part. Quotes, brackets and a leading ./ don't count. Others have no row.
    """
    bare = F.regexp_replace(F.btrim("target", F.lit("`'\"() ")), r"\A\./", "")
    asked = targets.select("target").distinct().withColumn("spec", bare).filter("spec <> ''")
    parts = F.split("path", "/")
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    only = files.select("path", tails.alias("spec")).distinct().groupBy("spec").agg(F.min("path").alias("by_path"), F.count("*").alias("n")).filter("n = 1").drop("n")
    dotted = modules(asked.filter(F.col("spec").rlike(r"\A[\w.]+\z")), files).select("spec", F.col("path").alias("by_module"))
    one = definitions.groupBy("name").agg(F.min("path").alias("by_name"), F.max("path").alias("last")).filter("by_name = last").drop("last")
    met = asked.join(only, "spec", "left").join(dotted, "spec", "left").withColumn("name", F.substring_index("spec", ".", -1)).join(one, "name", "left")
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_module").isNotNull(), "module").when(F.col("by_name").isNotNull(), "definition")
    return met.select("target", F.coalesce("by_path", "by_module", "by_name").alias("path"), how.alias("how")).filter("path is not null")


def checked_interactions(claims: DataFrame, files: DataFrame, definitions: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """(path, target, relationship, verified, place): claims (path, place, target, relationship) that name another known
    file and say how, the first `most` of a path; verified where an edge (a, b) joins the two in either direction."""
    names = resolved_targets(claims, files, definitions).select("target", F.col("path").alias("known"))
    good = claims.filter("trim(relationship) <> ''").join(names, "target").filter("known <> path")
    either = edges.select(F.col("a").alias("path"), F.col("b").alias("known")).union(edges.select("b", "a")).distinct().withColumn("verified", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("place"))
    first = good.withColumn("nth", nth).filter(F.col("nth") <= most)
    return first.join(either, ["path", "known"], "left").select("path", F.col("known").alias("target"), "relationship", F.coalesce("verified", F.lit(False)).alias("verified"), F.col("nth").alias("place"))


def known_symbols(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(path, kept, dropped): distinct claimed symbols (path, symbol), by their last dotted part without (), that the file
    has (path, name), and how many it doesn't."""
    name = F.regexp_replace(F.substring_index("symbol", ".", -1), r"[()]+\z", "")
    had = known.filter("path is not null and name is not null").select("path", "name", F.lit(False).alias("said"), F.lit(True).alias("ok"))
    rows = claims.select("path", name.alias("name"), F.lit(True).alias("said"), F.lit(False).alias("ok")).unionByName(had)
    with wide(rows.sparkSession, claims.count() + known.count()):
        met = rows.groupBy("path", "name").agg(F.max("said").alias("said"), F.max("ok").alias("ok")).filter("said")
        return written(met.groupBy("path").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped")), "claims")


def fact_view(facts: DataFrame, kind: str, pins: int = 2, view: int = 12) -> DataFrame:
    """(query_id, fact_id, path, place): the facts (query_id, fact_id, path, kind, named, rank, overlap) that a request sees.

    Facts of named files come first, then the first `pins` of the kind, then by rank of the file (from 0, null: unranked),
    words in common and number. Others enter only with words in common or a rank below `view`. A file that isn't named gives one fact.
    """
    mine = Window.partitionBy("query_id")
    at = F.row_number().over(mine.orderBy((F.col("kind") == kind).desc_nulls_last(), "fact_id"))
    pinned = F.coalesce(F.col("kind") == kind, F.lit(False)) & (at <= pins)
    seen = facts.withColumn("pinned", pinned).filter(F.col("named") | F.col("pinned") | (F.col("overlap") > 0) | (F.col("rank") < view))
    order = (F.desc("named"), F.desc("pinned"), F.asc_nulls_last("rank"), F.desc("overlap"), F.col("fact_id"))
    once = seen.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order))).filter("named or nth = 1")
    return once.withColumn("place", F.row_number().over(mine.orderBy(*order))).select("query_id", "fact_id", "path", "place")


def integrated(ranked: DataFrame, outside: DataFrame, key: str, mode: str, k: int = 20, weight: float = 1.0) -> DataFrame:
    """(query_id, key, place) of a ranking (query_id, key, rank, pinned) that meets an outside one (query_id, key, at).

    Only candidates count, each once. `seeds` leaves the order, `replace` puts the outside order first, `weighted` adds
    weight / (k + place) to 1 / (k + rank). Pinned ones stay before all others.
    """
    if mode not in ("seeds", "replace", "weighted"):
        raise ValueError(f"unknown mode: {mode}")
    said = outside.join(ranked.select("query_id", key), ["query_id", key], "left_semi").groupBy("query_id", key).agg(F.min("at").alias("at"))
    said = said.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at", key))).drop("at")
    met = ranked.join(said, ["query_id", key], "left")
    value = F.round(1 / (k + F.col("rank")) + F.coalesce(weight / (k + F.col("pos")), F.lit(0.0)), 9)
    rest = F.when(F.col("pinned"), None).otherwise(F.col("pos"))
    by = {"seeds": [F.col("rank")], "replace": [F.desc("pinned"), rest.asc_nulls_last(), F.col("rank")], "weighted": [F.desc("pinned"), value.desc(), F.col("rank")]}[mode]
    return met.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy(*by)).alias("place"))


def answers(requests: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(query_id, path, score): requests (query_id, position, type, value) answered from sources (type, value, path), which
    may have an `at` that orders the paths of a value.

    A request at position p gives 1 / p to the first `most` paths it finds; the `most` best of a query stay. The first paths
    of a value don't depend on who asks, so they are cut before the join, and no request meets more than `most` rows.
    """
    order = [F.col("at"), F.col("path")] if "at" in sources.columns else [F.col("path")]
    first = F.row_number().over(Window.partitionBy("type", "value").orderBy(*order))
    held = sources.distinct().withColumn("nth", first).filter(F.col("nth") <= most).drop("nth")
    nth = F.row_number().over(Window.partitionBy("query_id", "position").orderBy(*[c for c in ("at", "path") if c in sources.columns]))
    found = requests.join(held, ["type", "value"]).withColumn("nth", nth).filter(F.col("nth") <= most)
    total = found.groupBy("query_id", "path").agg(F.round(F.sum(1.0 / F.col("position")), 9).alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    return total.withColumn("nth", best).filter(F.col("nth") <= most).drop("nth")


def _links(defined: DataFrame, uses: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, kind, name): the names that a path defines (0) and uses (1), and whether it is a test (2)."""
    kind = lambda n: F.lit(n).alias("kind")
    return defined.select("path", kind(0), "name").union(uses.select("path", kind(1), "name")).union(tests.select("path", kind(2), F.lit(None)))


def _wants(wanted: DataFrame) -> DataFrame:
    """(query_id, names): the distinct wanted names of a query, null among them if it is wanted."""
    names = F.collect_set("name")
    return wanted.filter("query_id is not null").groupBy("query_id").agg(F.when(F.bool_or(F.isnull("name")), F.array_append(names, F.lit(None))).otherwise(names).alias("names"))


def _requests(view: DataFrame, wants: DataFrame, links: DataFrame, most: int, enough: float, how: str) -> DataFrame:
    """The requests of `next_requests`; `how` wants meet the queries of the view. Wanted names go with each shown path, so that
    of what the paths define and use only wanted names leave the join."""
    held = links.select(F.col("path").alias("__path"), "kind", "name")
    of = (F.col("path") == F.col("__path")) & ((F.col("kind") == 2) | F.array_contains("names", F.col("name")))
    met = view.select("query_id", "path", "rank").join(wants, "query_id", "left").join(held, of, "left").select("query_id", "path", "rank", "kind", "name")
    any_of = lambda n: F.max(F.coalesce(F.col("kind") == n, F.lit(False)))
    files = met.groupBy("query_id").agg(F.min_by("path", "rank").alias("first"), any_of(2).alias("tested"), any_of(1).alias("used"), F.collect_set(F.when(F.col("kind") == 0, F.col("name"))).alias("has"))
    known = files.join(wants, "query_id", how)
    in_use = F.isnull("names") | F.coalesce("used", F.lit(False))
    covered = F.coalesce(F.size("has") / F.when(F.size("names") > 0, F.size("names")), F.when(F.isnull("names"), 1.0).otherwise(0.0))
    sure = F.round(0.5 * covered + F.when(F.col("first").isNotNull() & in_use, 0.5).otherwise(0.0), 2)
    asked = lambda turn, kind, value: F.struct(turn.alias("turn"), value.cast("string").alias("value"), kind.alias("type"))
    has = lambda n: F.coalesce(F.array_contains("has", n), F.lit(False))
    names = F.filter(F.coalesce("names", F.array()), lambda n: ~has(n) | ~F.coalesce("used", F.lit(False)))
    by_name = F.transform(names, lambda n: asked(F.when(has(n), 1).otherwise(0), F.when(has(n), F.lit("callers")).otherwise(F.lit("symbol")), n))
    near = F.when(F.col("first").isNotNull() & ~F.col("tested"), F.array(asked(F.lit(2), F.lit("neighbors"), F.col("first"))))
    every = F.slice(F.array_sort(F.concat(by_name, F.coalesce(near, F.array()))), 1, most)
    asking = known.filter(sure < enough).select("query_id", F.posexplode(every).alias("at", "r"))
    return asking.select("query_id", (F.col("at") + 1).alias("position"), "r.type", "r.value")


def next_requests(ranked: DataFrame, wanted: DataFrame, defined: DataFrame, uses: DataFrame, tests: DataFrame, shown: int, most: int, enough: float) -> DataFrame:
    """(query_id, position, type, value) that the first `shown` paths of each ranking leave open.

    Wanted names (query_id, name) that no shown path defines ask for their symbol; those that are defined ask for callers if no
    shown path uses a wanted name; if no shown path is a test, the neighbours of the first are asked for. Names come in order, the
    first `most` requests stay. Half the share of names that are defined, and half for names in use (or none wanted), is the
    confidence; from `enough` on nothing is asked.
    """
    return _requests(ranked.filter(F.col("rank") <= shown), _wants(wanted), _links(defined, uses, tests), most, enough, "full")


def explored(ranked: DataFrame, wanted: DataFrame, defined: DataFrame, uses: DataFrame, near: DataFrame, tests: DataFrame, rounds: int = 2, protected: int = 5, shown: int = 8, most_requests: int = 12, most: int = 6, enough: float = 0.9) -> DataFrame:
    """(query_id, path, rank, round): rankings (query_id, path, rank from 1) after up to `rounds` rounds of requests.

    In each round what the ranking leaves open is asked for, from defined (name, path), uses (name, path, n), the most frequent
    first, and near (path, other), and what is found and wasn't shown goes below the first `protected` paths and what earlier
    rounds added. round is null for what was ranked. Queries whose round adds nothing ask no more; rankings are written between rounds.

    What is given is read once, before the rounds. A value keeps the first `most` paths that answer it, and values that many
    ask for are joined apart. In a round the rows of a query are brought together once.
    """
    uses = written(uses.select("name", "path", F.col("n").cast("long").alias("n")), "uses")
    wants, links = written(_wants(wanted), "wants"), written(_links(defined, uses, tests), "links")
    nth = F.dense_rank().over(Window.partitionBy("key").orderBy("at", "path"))  # repeated rows count once
    asks = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string")).alias("asked")
    first = lambda kind, rows: rows.filter("key is not null").withColumn("nth", nth).filter(F.col("nth") <= most).select(asks(kind, "key"), "at", "path").distinct()
    zero = F.lit(0).cast("long").alias("at")
    symbols, callers = defined.select(F.col("name").alias("key"), zero, "path"), uses.select(F.col("name").alias("key"), (-F.col("n")).alias("at"), "path")
    sources = first("symbol", symbols).union(first("callers", callers)).union(first("neighbors", near.select(F.col("path").alias("key"), zero, F.col("other").alias("path"))))
    sources = written(sources.drop("at"), "sources")
    now = written(ranked.select("query_id", "path", F.col("rank").cast("int").alias("rank"), F.lit(None).cast("int").alias("round"), F.lit(protected).alias("below"), F.lit(True).alias("asking")), "ranking")
    query = Window.partitionBy("query_id")
    for number in range(1, rounds + 1):
        view = now.filter((F.col("rank") <= shown) & F.col("asking") & F.col("query_id").isNotNull())
        asked = F.concat("type", F.lit(" "), "value").alias("asked")
        requests = written(_requests(view, wants, links, most_requests, enough, "left").select("query_id", "position", asked), "requests")
        met = look_up(requests, sources, "asked").select("query_id", "position", "path").repartition("query_id")
        total = met.groupBy("query_id", "path").agg(F.round(F.sum(1.0 / F.col("position")), 9).alias("score"))
        best = F.row_number().over(query.orderBy(F.desc("score"), "path"))
        found = total.withColumn("nth", best).filter(F.col("nth") <= most).drop("nth")
        both = now.drop("asking").withColumn("score", F.lit(None).cast("double")).unionByName(found, allowMissingColumns=True).repartition("query_id")
        was = F.col("below").isNotNull()
        same = Window.partitionBy("query_id", "path", F.isnull("path") & ~was)  # a null path is like no other
        met = both.withColumn("held", F.max("below").over(same)).withColumn("seen", F.coalesce(F.min("rank").over(same) <= shown, F.lit(False))).withColumn("score", F.max("score").over(same))
        rows = met.filter(was | F.isnull("held")).withColumn("score", F.when(~F.col("seen"), F.col("score")))
        rows = rows.withColumn("below", F.coalesce(F.max("below").over(query), F.lit(protected))).withColumn("added", F.count("score").over(query)).withColumn("n", F.count("*").over(query))
        old = F.isnull("score")
        nth = F.row_number().over(query.orderBy(~old, F.when(old, F.col("rank")).asc_nulls_last(), F.desc("score"), "path"))  # what is added comes after all others
        top = F.least("below", F.col("n") - F.col("added"))
        place = F.when(old & (F.col("nth") <= top), F.col("nth")).when(old, F.col("nth") + F.col("added")).otherwise(F.col("nth") - (F.col("n") - F.col("added")) + top)
        moved = rows.withColumn("nth", nth).withColumn("place", place.cast("int"))
        after = moved.select("query_id", "path", F.col("place").alias("rank"), F.when(F.col("score").isNotNull(), number).otherwise(F.col("round")).alias("round"), (F.col("below") + F.col("added")).cast("int").alias("below"), (F.col("added") > 0).alias("asking"))
        after = written(after, "ranking")
        if not after.filter("asking").limit(1).count():
            break
        now = after
    return now.select("query_id", "path", "rank", "round")


def inserted(ranked: DataFrame, found: DataFrame, protected: int, shown: int) -> DataFrame:
    """(query_id, path, place, added): found files (query_id, path, score) that aren't among the first `shown` go right below
    the first `protected` of a ranking (query_id, path, rank); what was ranked keeps its order."""
    met = ranked.join(found, ["query_id", "path"], "full").withColumn("added", F.col("score").isNotNull() & (F.coalesce("rank", F.lit(shown + 1)) > shown))
    nth = F.sum((~F.col("added")).cast("int")).over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rank"), F.desc("score"), "path"))
    band = F.when(F.col("added"), 1).when(nth <= protected, 0).otherwise(2)
    order = Window.partitionBy("query_id").orderBy("band", F.when(F.col("added"), -F.col("score")).otherwise(F.col("rank")), "path")
    return met.withColumn("band", band).select("query_id", "path", F.row_number().over(order).alias("place"), "added")


def traits(results: DataFrame) -> DataFrame:
    """(query_id, trait) read from results (query_id, target, folder, source, rank, named), a row for each target and source
    that found it (null where none did)."""
    at = lambda s: F.coalesce(F.min(F.when(F.col("source") == s, F.col("rank"))), F.lit(999))
    facts = results.groupBy("query_id").agg(F.bool_or("named").alias("named"), at("symbol_definitions").alias("symbol"), at("bm25").alias("lexical"), F.min("target").alias("t0"), F.max("target").alias("t1"), F.min("folder").alias("f0"), F.max("folder").alias("f1"))
    rules = {"explicit path": F.col("named"), "explicit symbol": F.col("symbol") <= 3, "strong lexical": F.col("lexical") <= 10, "weak lexical": F.col("lexical") > 10, "cross-file": F.col("t0") != F.col("t1"), "multi-directory targets": F.col("f0") != F.col("f1")}
    return facts.select("query_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("trait"))
