"""Scorers beyond plain terms: paths, definitions, weighted fields, past tasks, claims and candidate sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.operators.index import TERM, idf
from millrace.sources.tables import join_hot, look_up, written

# Weights of the classes of path evidence, of which only the first that fits counts.
STEM_EXACT, STEM_TOKEN, DIRECTORY, PARTIAL, PARTIAL_CHARS = 3.0, 2.0, 1.0, 0.5, 5
# Factors for a name in other case, a method, and a name asked for with its parent.
OTHER_CASE, METHOD, QUALIFIED = 0.6, 0.8, 2.0


def path_evidence(queries: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) for terms (query_id, term, w) found in paths (key, stem, stem_tokens, directory_tokens).

    Terms meet tokens by equality. Terms inside a stem are found by its five-character pieces and then checked, so
    that no product of terms and paths arises. A path without any token has no row.
    """
    classed = lambda c, n: F.transform(F.coalesce(c, F.array()), lambda t: F.struct(t.alias("term"), F.lit(n).alias("gain")))
    every = F.concat(classed(F.array("stem"), STEM_EXACT), classed(F.col("stem_tokens"), STEM_TOKEN), classed(F.col("directory_tokens"), DIRECTORY))
    tokens = paths.select(key, F.inline(every)).groupBy(key, "term").agg(F.max("gain").alias("gain"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("stem") - PARTIAL_CHARS + 1), lambda i: F.substring(F.col("stem"), i, F.lit(PARTIAL_CHARS)))
    inside = paths.filter(F.length("stem") >= PARTIAL_CHARS).select(key, "stem", F.explode(F.array_distinct(pieces)).alias("piece"))
    long = queries.filter(F.length("term") >= PARTIAL_CHARS).withColumn("piece", F.substring("term", 1, PARTIAL_CHARS))
    partial = inside.join(long, "piece").filter(F.col("stem").contains(F.col("term"))).select("query_id", "term", "w", key, F.lit(PARTIAL).alias("gain"))
    met = tokens.join(queries, "term").select("query_id", "term", "w", key, "gain").union(partial).groupBy("query_id", "term", "w", key).agg(F.max("gain").alias("gain"))
    asked = queries.select("term").distinct()
    df = tokens.join(asked, "term").groupBy("term").agg(F.count("*").alias("df"))
    n = paths.agg(F.count("*").alias("n"))  # one row
    rarity = idf(F.col("n"), F.coalesce("df", F.lit(0)))
    return met.join(df, "term", "left").join(F.broadcast(n), F.lit(True)).groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("gain") * rarity).alias("score"))


def _path_hits(terms: DataFrame, paths: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, term, gain), (term, df)): the asked terms (term, distinct, written) in each path, and how many paths have one as a token.

    A stem is cut into runs of characters as wide as asked terms are, which are looked up; so stems that begin alike don't
    meet all terms that do.
    """
    classed = lambda c, n: F.transform(F.coalesce(c, F.array()), lambda t: F.struct(t.alias("term"), F.lit(n).alias("gain")))
    every = F.concat(classed(F.array("stem"), STEM_EXACT), classed(F.col("stem_tokens"), STEM_TOKEN), classed(F.col("directory_tokens"), DIRECTORY))
    tokens = written(paths.select(key, F.inline(every)).groupBy(key, "term").agg(F.max("gain").alias("gain")), "tokens")
    tokens = written(look_up(tokens, terms, "term").select(key, "term", "gain"), "tokens")
    long = terms.filter(F.length("term") >= PARTIAL_CHARS)
    widths = long.agg(F.collect_set(F.length("term")).alias("widths"))  # one row
    stems = paths.select(key, "stem").filter(F.length("stem") >= PARTIAL_CHARS)
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length("stem") - w + 1), lambda i: F.substring(F.col("stem"), i, w))
    runs = F.flatten(F.transform(F.filter("widths", lambda w: w <= F.length("stem")), cut))
    own = stems.select("stem").distinct().join(F.broadcast(widths), F.lit(True))
    pieces = written(own.select("stem", F.explode(F.array_distinct(runs)).alias("term")), "pieces")
    inside = written(look_up(pieces, long, "term").select("stem", "term"), "inside")
    partial = look_up(stems, inside, "stem").select(key, "term", F.lit(PARTIAL).alias("gain"))
    return tokens.unionByName(partial).groupBy(key, "term").agg(F.max("gain").alias("gain")), tokens.groupBy("term").agg(F.count("*").alias("df"))


def _parts(rows: DataFrame, own: str, value: str) -> DataFrame:
    """(own, part, value): every choice of one term or more from sorted `terms` (term, value), by the digest of its terms and with its values."""
    every = F.expr("transform(sequence(1, shiftleft(1, size(terms)) - 1), m -> filter(terms, (x, i) -> (shiftright(m, i) & 1) = 1))")
    return rows.select(own, F.explode(every).alias("part")).select(own, F.unhex(F.sha2(F.to_json("part.term"), 256)).alias("part"), f"part.{value}")


def best_paths(queries: DataFrame, paths: DataFrame, key: str, k: int, digits: int = 9, few: int = 50, most: int = 8) -> DataFrame:
    """The (query_id, key, score) of `path_evidence` with the k best of each query among them, by score, then key; keys are
    unique and weights not negative.

    Terms that more than `few` queries ask for and more than `few` paths have are common. Paths with another term of a query,
    which are few, are scored one by one. Paths with the same common terms are one class, as are queries. Those of `most`
    common terms or fewer meet by parts: for every choice of terms the first k paths that have it, and with the same gains, are
    kept, and a query takes those of its choices. A path is first found by all that it shares with a query; if k others come before it
    there, they have as much and smaller keys, so it is not among the k best. So no class meets another, however many there are.
    Classes of more common terms, which have too many choices, meet the others one by one. Other work grows with the rows.
    """
    asked = written(queries.select("query_id", "term", "w").distinct().groupBy("query_id", "term").agg(F.sum("w").alias("w")), "asked")
    counts = written(asked.filter("term is not null").groupBy("term").agg(F.count("*").alias("asked")), "counts")
    hits, df = _path_hits(counts.select("term"), paths, key)
    hits = written(hits, "hits")
    n = paths.agg(F.count("*").alias("n"))  # one row
    held = counts.join(hits.groupBy("term").agg(F.count("*").alias("held")), "term").join(df, "term", "left").join(F.broadcast(n), F.lit(True))
    facts = written(held.select("term", "asked", "held", idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("rarity"), (F.least("asked", "held") > few).alias("common")), "facts")
    asked = written(join_hot(asked, facts, "term", "asked").select("query_id", "term", (F.col("w") * F.col("rarity")).alias("w"), "common"), "asked")
    hits = written(join_hot(hits, facts, "term", "held").select(key, "term", "gain", "common"), "hits")

    def classes(rows: DataFrame, own: str, value: str, name: str) -> tuple[DataFrame, DataFrame]:
        terms = F.array_sort(F.collect_list(F.struct("term", value)))
        found = written(rows.filter("common").groupBy(own).agg(terms.alias("terms")).select(own, "terms", F.sha2(F.to_json("terms"), 256).alias(name)), name)
        return found.select(own, name), written(found.groupBy(name).agg(F.first("terms").alias("terms")).withColumn("deep", F.size("terms") > most), name)

    asking, wants = classes(asked, "query_id", "w", "q_class")
    having, gives = classes(hits, key, "gain", "p_class")
    first = F.row_number().over(Window.partitionBy("p_class").orderBy(key))
    members = written(having.withColumn("at", first).filter(F.col("at") <= k), "members")

    wanted = written(_parts(wants.filter("not deep"), "q_class", "w"), "wanted")
    first = F.row_number().over(Window.partitionBy("part", "gain").orderBy(key))
    parts = _parts(gives.filter("not deep"), "p_class", "gain").join(members.select("p_class", key), "p_class").withColumn("at", first).filter(F.col("at") <= k)
    leaders = written(parts.join(wanted.select("part").distinct(), "part", "left_semi").select("part", "gain", key), "leaders")
    score = F.aggregate(F.zip_with("w", "gain", lambda w, g: w * g), F.lit(0.0), lambda a, b: a + b)
    met = look_up(wanted, leaders, "part").select("q_class", key, F.round(score, digits).alias("score"))

    order = Window.partitionBy("q_class").orderBy(F.desc("score"), key)
    terms = lambda rows, name: rows.select(name, F.inline("terms"))
    deep = [(wants.filter("deep"), gives), (wants.filter("not deep"), gives.filter("deep"))]
    one, two = (terms(q, "q_class").join(terms(p, "p_class"), "term").groupBy("q_class", "p_class").agg(F.round(F.sum(F.col("w") * F.col("gain")), digits).alias("score")) for q, p in deep)
    leading = one.unionByName(two).join(members.filter("at = 1").select("p_class", key), "p_class").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    spread = leading.select("q_class", "p_class", "score").join(members.select("p_class", key), "p_class").select("q_class", key, "score")
    best = met.unionByName(spread).groupBy("q_class", key).agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    by_class = asking.join(best.select("q_class", key, "score"), "q_class").select("query_id", key, "score")
    rare = asked.filter("not common").join(hits.filter("not common").select("term", key), "term").select("query_id", key).distinct()
    each = rare.join(asked.select("query_id", "term", "w"), "query_id").join(hits.select(key, "term", "gain"), [key, "term"])
    each = each.groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("gain")).alias("score"))
    return each.unionByName(by_class).groupBy("query_id", key).agg(F.max("score").alias("score"))


def definitions(names: DataFrame, defined: DataFrame, qualified: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) for names (query_id, name, w) against (key, name, kind, parent): w over the square root of
    how many keys define the name. Only a name with no exact match falls back to names of the same letters;
    `qualified` has (query_id, parent, name)."""
    exact = names.join(defined.select("name").distinct(), "name", "left_semi").select("query_id", F.col("name").alias("found"), "w")
    lower = defined.select(F.col("name").alias("found")).distinct().withColumn("low", F.lower("found"))
    loose = names.join(defined.select("name").distinct(), "name", "left_anti").withColumn("low", F.lower("name")).join(lower, "low").select("query_id", "found", (F.col("w") * OTHER_CASE).alias("w"))
    spread = defined.groupBy("name").agg(F.count_distinct(key).alias("spread"))
    met = exact.union(loose).withColumnRenamed("found", "name").join(spread, "name").join(defined, "name")
    met = met.join(qualified.distinct().withColumn("q", F.lit(QUALIFIED)), ["query_id", "parent", "name"], "left")
    gain = F.col("w") / F.sqrt("spread") * F.when(F.col("kind") == "method", METHOD).otherwise(1.0) * F.coalesce("q", F.lit(1.0))
    return met.groupBy("query_id", key).agg(F.sum(gain).alias("score"))


def weighted_postings(texts: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) where an occurrence counts as its field's weight; texts has (key, weight, text)."""
    terms = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    return texts.select(key, "weight", F.explode(terms).alias("term")).groupBy(key, "term").agg(F.sum("weight").alias("tf"))


def multi_field(queries: DataFrame, texts: DataFrame, key: str, k: int = 10, strong: float = 3.0, floor: float = 0.25) -> DataFrame:
    """BM25 of each field by that field's own statistics, summed. texts has (key, field, weight, bulk, text).

    Returns the k best a query with support (occurrences of strong terms), concepts (distinct weaker terms) and weak:
    generic words only, or under `floor` of the leader. Scores of bulk records count 0.3.
    """
    terms = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    p = texts.select(key, "field", "weight", "bulk", F.explode(terms).alias("term")).groupBy(key, "field", "term").agg(F.count("*").alias("tf"), F.max("weight").alias("weight"), F.max("bulk").alias("bulk"))
    lengths = p.groupBy(key, "field").agg(F.sum("tf").alias("len"))
    n = texts.agg(F.count_distinct(key).alias("n"))  # one row
    average = lengths.groupBy("field").agg(F.sum("len").alias("total"))
    asked = p.join(queries, "term")
    df = p.join(queries.select("term").distinct(), "term").groupBy("field", "term").agg(F.count("*").alias("df"))
    m = asked.join(df, ["field", "term"]).join(lengths, [key, "field"]).join(average, "field").join(F.broadcast(n), F.lit(True))
    norm = F.col("tf") + 1.2 * (1 - 0.75 + 0.75 * F.col("len") / (F.col("total") / F.col("n")))
    gain = F.col("weight") * F.col("w") * idf(F.col("n"), F.col("df")) * F.col("tf") * 2.2 / norm
    heavy = F.col("w") >= strong
    got = m.groupBy("query_id", key).agg(F.sum(gain).alias("score"), F.count(F.when(heavy, 1)).alias("support"), F.count_distinct(F.when(~heavy, F.col("term"))).alias("concepts"), F.max("bulk").alias("bulk"))
    got = got.withColumn("score", F.round(F.col("score") * F.when(F.col("bulk"), 0.3).otherwise(1.0), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    got = got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    leader = F.first("score").over(order)
    weak = ((F.col("support") == 0) & (F.col("concepts") < 2)) | ((F.col("rank") > 1) & (F.col("score") < leader * floor))
    return got.select("query_id", key, "score", "support", "concepts", weak.alias("weak"), "rank")


def similar_tasks(queries: DataFrame, events: DataFrame, least: float) -> DataFrame:
    """(query_id, event_id, similarity): cosine of query terms (query_id, term, w) and event terms (event_id, term, tf)."""
    mine = queries.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    theirs = events.groupBy("event_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("en"))
    dot = events.join(queries, "term").groupBy("query_id", "event_id").agg(F.sum(F.col("w") * F.col("tf")).alias("dot"))
    near = dot.join(mine, "query_id").join(theirs, "event_id")
    return near.select("query_id", "event_id", F.round(F.col("dot") / (F.col("qn") * F.col("en")), 9).alias("similarity")).filter(F.col("similarity") >= least)


def experience_votes(similar: DataFrame, events: DataFrame, least_support: int, half_life_days: float, changed_factor: float) -> DataFrame:
    """(query_id, path, support, score): similarity times outcome weight times recency, for the files of similar events.

    events has (event_id, path, changed, outcome_weight, age_days); an outcome without weight gives nothing.
    """
    weight = F.col("similarity") * F.col("outcome_weight") * F.pow(F.lit(0.5), F.col("age_days") / half_life_days)
    gain = weight * F.when(F.col("changed"), changed_factor).otherwise(1.0)
    met = similar.join(events, "event_id").filter("outcome_weight > 0")
    return met.groupBy("query_id", "path").agg(F.count("*").alias("support"), F.sum(gain).alias("score")).filter(F.col("support") >= least_support)


def claims(queries: DataFrame, terms: DataFrame, evidence: DataFrame, most_files: int) -> DataFrame:
    """(query_id, path, score): matched claims hand the sum of their terms' rarity to the files they cite, split by the
    square root of how many. terms has (claim_id, term), distinct; evidence has (claim_id, path, place)."""
    n = terms.agg(F.count_distinct("claim_id").alias("n"))  # one row
    asked = terms.join(queries, "term")
    df = terms.join(queries.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    gains = asked.join(df, "term").join(F.broadcast(n), F.lit(True)).groupBy("query_id", "claim_id").agg(F.sum(F.col("w") * idf(F.col("n"), F.col("df"))).alias("gain"))
    cited = evidence.groupBy("claim_id", "path").agg(F.min("place").alias("place"))
    cited = cited.withColumn("r", F.row_number().over(Window.partitionBy("claim_id").orderBy("place", "path"))).filter(F.col("r") <= most_files)
    files = cited.groupBy("claim_id").agg(F.count("*").alias("files"))
    return gains.join(cited, "claim_id").join(files, "claim_id").groupBy("query_id", "path").agg(F.sum(F.col("gain") / F.sqrt("files")).alias("score"))


def prefix_overlap(words: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, label, n): distinct words (query_id, word) that equal a token (label, token), or where one of both
    begins the other with four characters or more."""
    words, labels = words.distinct(), labels.distinct()
    same = words.join(labels, words.word == labels.token).select("query_id", "label", "word")
    a, b = words.withColumn("p", F.substring("word", 1, 4)), labels.withColumn("p", F.substring("token", 1, 4))
    begins = a.join(b, "p").filter((F.length("word") >= 4) & (F.length("token") >= 4) & (F.startswith("token", "word") | F.startswith("word", "token"))).select("query_id", "label", "word")
    return same.union(begins).distinct().groupBy("query_id", "label").agg(F.count("*").alias("n"))


def candidate_shares(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, candidate, share) by rarity within the candidates themselves. candidates has (candidate, term, side)
    with side positive, tag or negative: a tag counts 2.5 in all, a negative term minus 0.75; no score falls below 0."""
    ask, held = tasks.select("query_id", "term").distinct(), candidates.distinct()
    n = candidates.agg(F.count_distinct("candidate").alias("n"))  # one row
    positive = held.filter("side <> 'negative'").select("candidate", "term").distinct()
    df = positive.groupBy("term").agg(F.count("*").alias("df"))
    sides = positive.withColumn("f", F.lit(1.0)).union(held.filter("side = 'tag'").select("candidate", "term", F.lit(1.5))).union(held.filter("side = 'negative'").select("candidate", "term", F.lit(-0.75)))
    met = ask.join(sides, "term").join(df, "term").join(F.broadcast(n), F.lit(True))
    scored = met.groupBy("query_id", "candidate").agg(F.greatest(F.lit(0.0), F.sum(F.col("f") * F.log(1 + F.col("n") / F.col("df")))).alias("score"))
    total = scored.groupBy("query_id").agg(F.sum("score").alias("total"))
    return scored.join(total, "query_id").filter("score > 0").select("query_id", "candidate", F.round(F.col("score") / F.col("total"), 4).alias("share"))
