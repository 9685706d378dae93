"""From ranked seeds to more candidates, and what the evidence of a ranking is worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Weights of the kinds of edges, the names of their other direction, and the kinds that count as incoming.
PRIORS = {"calls": 1.0, "called_by": 1.0, "references": 0.8, "referenced_by": 0.8, "inherits": 0.8, "inherited_by": 0.8, "tested_by": 0.7, "tests": 0.7, "imports": 0.5, "imported_by": 0.5}
REVERSED = {"imports": "imported_by", "calls": "called_by", "references": "referenced_by", "inherits": "inherited_by", "tested_by": "tests"}
INCOMING = ("imports", "references", "calls", "inherits")
# Weights of the kinds of files; a kind that isn't here keeps its score.
KIND_WEIGHTS = {"source": 1.0, "test": 0.5, "doc": 0.5, "config": 0.7, "manifest": 0.7, "schema": 0.8, "migration": 0.8, "workflow": 0.5, "other": 0.5}


def lookup(key: Column, values: dict[str, object], otherwise: object) -> Column:
    """The value of a short fixed table for the key."""
    return reduce(lambda rest, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(rest), reversed(values.items()), F.lit(otherwise))


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, kind) in both directions; the other direction has its own kind."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), lookup(F.col("kind"), REVERSED, None).alias("kind"))
    return edges.select("a", "b", "kind").union(back)


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind").isin(*INCOMING)).groupBy(F.col("b").alias("node")).agg(F.count_distinct("a").alias("in_degree"))


def expand_graph(seeds: DataFrame, edges: DataFrame, decays: tuple[float, ...] = (0.5, 0.25), per_seed: int = 8, most: int = 20) -> DataFrame:
    """(node, score, origins, kind, rank) of the best neighbours of seeds (node, rank), one hop for each of `decays`.

    An edge gives strength * decay * prior / ln(2 + in-degree), where a seed's strength is 1 / rank; of several edges
    between two nodes the strongest counts. Each node gives to its `per_seed` best neighbours, and the `most` best of
    those lead on, so that a hop begins from few rows. Ties go to the name. kind is that of the strongest edge.
    """
    both, degrees = neighbours(edges).distinct(), in_degrees(edges)
    front, hops = seeds.select("node", (F.lit(1.0) / F.col("rank")).alias("strength")), []
    for decay in decays:
        met = F.broadcast(front.withColumnRenamed("node", "a")).join(both, "a").join(degrees.withColumnRenamed("node", "b"), "b", "left")  # seeds, or `most` rows
        value = F.col("strength") * decay * lookup(F.col("kind"), PRIORS, 0.0) / F.log(2 + F.coalesce("in_degree", F.lit(0)))
        best = met.groupBy("a", "strength", "b").agg(F.max(F.struct(F.round(value, 9).alias("value"), F.col("kind"))).alias("best")).filter("best.value > 0")
        order = Window.partitionBy("a", "strength").orderBy(F.desc("best.value"), "b")
        kept = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_seed).select("a", F.col("b").alias("node"), "best.value", "best.kind")
        hops.append(kept)
        front = kept.select("node", F.col("value").alias("strength"), "a").orderBy(F.desc("strength"), "node", "a").limit(most).drop("a")
    found = reduce(DataFrame.union, hops).groupBy("node").agg(F.round(F.sum("value"), 6).alias("score"), F.count("*").alias("origins"), F.max(F.struct("value", "kind")).alias("why"))
    top = found.select("node", "score", "origins", F.col("why.kind").alias("kind")).orderBy(F.desc("score"), "node").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node")))  # `most` rows


def expand_cochange(seeds: DataFrame, partners: DataFrame, floor: float = 0.1, least_support: int = 2, most: int = 10) -> DataFrame:
    """(b, score, seeds) of the items that changed with seeds (a, rank): the sum of score / rank over seeds."""
    strong = partners.filter((F.col("score") >= floor) & (F.col("support") >= least_support))
    met = strong.join(seeds, "a").groupBy("b").agg(F.round(F.sum(F.col("score") / F.col("rank")), 6).alias("score"), F.count("*").alias("seeds"))
    return met.orderBy(F.desc("score"), "b").limit(most)


def reranked(candidates: DataFrame, query: str, path: str, lifted: tuple[str, ...] = ()) -> DataFrame:
    """Adds value and place: pinned ones first, then score by kind weight, then evidence, then path.

    candidates has kind, score, named, in_degree and sources, an array. Kinds in `lifted` and named paths keep their
    score. Evidence is a definition, then a path match, the number of identifier sources and of graph sources, and few
    incoming edges. A query's candidates are a short list.
    """
    holds = lambda name: F.array_contains("sources", name).cast("int")
    weight = F.when(F.col("named") | F.col("kind").isin(*lifted), 1.0).otherwise(lookup(F.col("kind"), KIND_WEIGHTS, 1.0))
    names = F.array(*map(F.lit, ("path", "symbol_definitions", "symbol_references", "phrases", "explorer")))
    graph = F.array(F.lit("graph"), F.lit("git"))
    held = candidates.withColumn("value", F.round(F.col("score") * weight, 9))
    many = lambda own: F.size(F.array_intersect("sources", own))
    order = Window.partitionBy(query).orderBy(F.desc("named"), F.desc("value"), F.desc(holds("symbol_definitions")), F.desc(holds("path")), F.desc(many(names)), F.desc(many(graph)), "in_degree", path)
    return held.withColumn("place", F.row_number().over(order))


def confidence(fused: DataFrame, lists: DataFrame, named: DataFrame, query: str, path: str) -> DataFrame:
    """(query, agreement, gap, pinned): how many lists have the same leader, its lead over the second, and whether the
    query names a file. fused and lists have rank and score; a lone leader has the gap 1."""
    top = fused.filter("rank <= 2").groupBy(query).agg(F.max(F.when(F.col("rank") == 1, F.col(path))).alias("leader"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    agree = lists.filter("rank = 1").join(top.select(query, "leader"), query).filter(F.col(path) == F.col("leader")).groupBy(query).agg(F.count("*").alias("agreement"))
    gap = F.when(F.col("second").isNull() | (F.col("first") == 0), 1.0).otherwise(F.round((F.col("first") - F.col("second")) / F.col("first"), 4))
    met = top.join(agree, query, "left").join(named.select(query).distinct().withColumn("pinned", F.lit(True)), query, "left")
    return met.select(query, F.coalesce("agreement", F.lit(0)).alias("agreement"), gap.alias("gap"), F.coalesce("pinned", F.lit(False)).alias("pinned"))


def gate(top: DataFrame, least_score: float, least_separation: float, least_concepts: int) -> Column:
    """What may be done with memory records, as a column over first, second, identifiers, concepts, resolved and stale."""
    weak = F.col("first").isNull() | (F.col("first") < least_score) | ((F.col("first") - F.col("second")) / F.col("first") < least_separation)
    weak = weak | ((F.col("identifiers") == 0) & (F.col("concepts") < least_concepts))
    return F.when(F.col("stale"), "ignore_stale").when(weak, "ignore_weak").when(F.col("resolved") == 0, "ignore_unresolved").when(F.col("identifiers") == 0, "use_limited").otherwise("use")


def calibrated(names: DataFrame, query: str, concept: float = 1.0, identifier: float = 3.0) -> DataFrame:
    """Adds weight to names (query, name, defines, files, mentions): 0 definitions weigh as a concept, one file as an
    identifier, n files between the two by 1 / sqrt(n), but for the one most mentioned of several ambiguous names."""
    ambiguous = (F.col("defines") > 0) & (F.col("files") > 1)
    tally = names.filter(ambiguous).groupBy(query).agg(F.count("*").alias("n"), F.max("mentions").alias("most"))
    leaders = names.filter(ambiguous).join(tally, query).filter("mentions = most and n > 1").groupBy(query).agg(F.count("*").alias("tied"), F.max("name").alias("leader"))
    met = names.join(leaders.filter("tied = 1").select(query, "leader"), query, "left")
    between = concept + (identifier - concept) / F.sqrt("files")
    weight = F.when(F.col("defines") == 0, concept).when(F.col("files") == 1, identifier).when(F.col("leader") == F.col("name"), identifier).otherwise(between)
    return met.withColumn("weight", F.round(weight, 6)).drop("leader")


def grouped_votes(votes: DataFrame, path: str, group: str, gain: Column) -> DataFrame:
    """(path, score): the best gain of each provenance group counts once, and groups are summed."""
    best = votes.groupBy(path, group).agg(F.max(gain).alias("best"))
    return best.groupBy(path).agg(F.round(F.sum("best"), 6).alias("score"))


def class_edges(bases: DataFrame, definitions: DataFrame, most: int = 3) -> DataFrame:
    """(path, target, base): base classes (path, base) resolved where one to `most` files define a class of the name."""
    classes = definitions.filter("kind = 'class'").select(F.col("name").alias("base"), F.col("file").alias("target")).distinct()
    few = classes.groupBy("base").agg(F.count("*").alias("files")).filter(F.col("files") <= most)
    return bases.select("path", "base").distinct().join(classes.join(few.select("base"), "base"), "base").filter("path <> target").select("path", "target", "base")


def tested_by(tests: DataFrame, sources: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, test, how): tests (test, stem) meet sources (source, stem) of the same stem, or ones that they import
    (test, source); the name counts first."""
    named = tests.join(sources, "stem").select("source", "test", F.lit("test name").alias("how"))
    imported = imports.join(tests.select("test").distinct(), "test", "left_semi").join(sources.select("source").distinct(), "source", "left_semi").select("source", "test", F.lit("test import").alias("how"))
    return named.union(imported).groupBy("source", "test").agg(F.max("how").alias("how"))
