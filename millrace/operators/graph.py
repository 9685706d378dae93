"""Bounded expansion, reach and personalised PageRank over edges (a, b)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from millrace.sources.tables import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))


def expand(seeds: DataFrame, edges: DataFrame, decay: float) -> DataFrame:
    """One hop from seeds (node, strength): strength times decay over ln(2 + degree), summed over origins."""
    both = both_ways(edges)
    degree = both.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("d"))
    met = both.join(seeds.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "strength").join(degree, "node")
    return met.groupBy("node").agg(F.sum(F.col("strength") * decay / F.log(2 + F.col("d"))).alias("strength"), F.count("*").alias("origins"))


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(node, distance) up to so many hops in either direction. Each hop keeps distinct nodes only."""
    both, front = both_ways(edges), seeds.select("node").distinct()
    found = front.withColumn("distance", F.lit(0))
    for hop in range(1, hops + 1):
        front = both.join(front.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        found = found.union(front.withColumn("distance", F.lit(hop)))
    return found.groupBy("node").agg(F.min("distance").alias("distance"))


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): all that the seeds (node) lead to along edges (a, b), without the seeds. Each round follows only what the one
    before found, which is written, and it ends when nothing is new, in cycles too."""
    links = edges.select("a", "b").distinct()
    front = written(seeds.select("node").distinct(), "front")
    found = front
    while True:
        front = written(links.join(front.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti"), "front")
        if front.isEmpty():
            return found.join(seeds.select("node"), "node", "left_anti")
        found = written(found.union(front), "found")


def pruned(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(role, id) of a graph cut to its first `most` nodes (node, path, place) so that nothing dangles.

    Edges (a, b, kind, resolved, path) need both ends; seeds (node) must be there; upstream and downstream follow resolved
    calls and imports from them; sources are the paths of what is left. Roles: node, edge (a>b), seed, upstream, downstream, source.
    """
    kept = written(nodes.orderBy("place", "node").limit(most), "nodes")  # the bound is the operator's purpose
    ids = kept.select("node")
    ends = edges.join(ids.withColumnRenamed("node", "a"), "a", "left_semi").join(ids.withColumnRenamed("node", "b"), "b", "left_semi")
    links, first = written(ends, "edges"), seeds.select("node").distinct().join(ids, "node", "left_semi")
    solid = links.filter("resolved and kind in ('calls', 'imports')")
    sides = {"downstream": reached(first, solid), "upstream": reached(first, solid.select(F.col("b").alias("a"), F.col("a").alias("b")))}
    sources = kept.select("path").union(links.select("path")).filter("path is not null").distinct().select(F.col("path").alias("node"))
    named = {"node": ids, "edge": links.select(F.concat("a", F.lit(">"), "b").alias("node")).distinct(), "seed": first, "source": sources, **sides}
    out = None
    for role, rows in named.items():
        part = rows.select(F.lit(role).alias("role"), F.col("node").alias("id"))
        out = part if out is None else out.union(part)
    return out


def follow(links: DataFrame, group: str, name: str, to: str, hops: int) -> DataFrame:
    """Where each (group, name) is after at most `hops` links. The hops are joins in a row; a link is one row."""
    at = links.select(group, name, F.col(name).alias("at"), F.lit(0).alias("hops"))
    step = links.select(group, F.col(name).alias("at"), F.col(to).alias("further"))
    for _ in range(hops):
        at = at.join(step, [group, "at"], "left").select(group, name, F.coalesce("further", "at").alias("at"), (F.col("hops") + F.col("further").isNotNull().cast("int")).alias("hops"))
    return at


def closure(needs: DataFrame, group: str, name: str, to: str, broken: str) -> DataFrame:
    """(group, name, dependencies, broken): all that a name needs, directly or not, and whether any of that or itself is
    broken. Pairs are written between rounds, each of which doubles their reach, until none is new; so a cycle ends."""
    step = needs.select(group, F.col(name).alias("at"), F.col(broken).alias("bad"))
    own = needs.select(group, name, F.col(name).alias("at"))
    direct = needs.join(step.select(group, F.col("at").alias(to)).distinct(), [group, to], "left_semi")
    every = written(own.union(direct.select(group, name, F.col(to).alias("at"))).distinct(), "closure")
    held = every.count()
    while True:
        onward = every.select(group, F.col(name).alias("at"), F.col("at").alias("further"))
        every = written(every.join(onward, [group, "at"]).select(group, name, F.col("further").alias("at")).distinct(), "closure")
        if (now := every.count()) == held:
            break
        held = now
    met = every.join(step.distinct(), [group, "at"])
    return met.groupBy(group, name).agg((F.count_distinct("at") - 1).alias("dependencies"), F.max(F.coalesce("bad", F.lit(False))).alias("broken"))


def personalised_pagerank(seeds: DataFrame, edges: DataFrame, iterations: int = 16, restart: float = 0.25, parts: int | None = None) -> DataFrame:
    """(node, score) with restarts at the seeds, which also get the mass of nodes without edges. Only seeds can be without
    edges, so that mass follows from their share alone, and each iteration reads the scores once. Nodes are numbers while
    they are walked; the links are dealt by their start once and kept in place, so that only sums by node move. There are
    as many parts as shuffle partitions, if not told otherwise. The scores are written after every fourth iteration, so
    that neither plans nor lineage grow.
    """
    spark = edges.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both_ways(edges.filter("a is not null and b is not null")).distinct()
    first = written(seeds.select("node").filter("node is not null").distinct(), "personal")
    named = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d")).join(first.withColumn("seed", F.lit(True)), "node", "full")
    nodes = written(named.select("node", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("seed", F.lit(False)).alias("seed"), F.monotonically_increasing_id().alias("i")), "nodes")
    n, lonely = nodes.agg(F.count_if("seed"), F.count_if(F.col("seed") & (F.col("d") == 0))).first()
    start = nodes.filter("seed").select(F.col("i").alias("node"), F.lit(1 / n if n else 0.0).alias("p"))
    ends = both.join(nodes.select(F.col("node").alias("b"), F.col("i").alias("to")), "b").join(nodes.filter("d > 0").select(F.col("node").alias("a"), F.col("i").alias("from"), "d"), "a")
    links = written(ends.select("from", "to", "d"), "links").repartition(parts, "from").persist(StorageLevel.DISK_ONLY)
    score, idle = start.withColumnRenamed("p", "score"), lonely / n if n else 0.0
    share = idle
    for i in range(iterations):
        kept = (1 - restart) * (1 - idle)
        idle = share * (1 - kept)
        moved = links.join(score.withColumnRenamed("node", "from"), "from").select(F.col("to").alias("node"), ((1 - restart) * F.col("score") / F.col("d")).alias("m"))
        score = moved.union(start.select("node", F.col("p") * (1 - kept))).groupBy("node").agg(F.sum("m").alias("score"))
        if i % 4 == 3 or i == iterations - 1:
            score = written(score, "scores")
    links.unpersist()
    return score.join(nodes.select(F.col("i").alias("node"), F.col("node").alias("__name")), "node").select(F.col("__name").alias("node"), "score")
