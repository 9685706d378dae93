"""A small view of a graph for each task: nodes near what the task names, edges between them, and paths along calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.operators.expansion import lookup
from millrace.sources.tables import wide, written

#: Kinds of edges in the order in which they are shown; others come after them.
SHOWN = {"calls": 0, "imports": 1}


def _near(seeds: DataFrame, both: DataFrame, hops: int) -> DataFrame:
    """(task_id, node) within `hops` edges of the seeds, these included. Only what is new is followed."""
    front = every = written(seeds.select("task_id", "node").distinct(), "near")
    for _ in range(hops):
        met = front.join(both, front["node"] == both["a"]).select("task_id", F.col("b").alias("node")).distinct()
        front = written(met.join(every, ["task_id", "node"], "left_anti"), "near")
        every = every.union(front)
    return written(every, "near")


def ranked_nodes(hits: DataFrame, edges: DataFrame, seeds: int = 4, hops: int = 2, iterations: int = 16, restart: float = 0.25) -> DataFrame:
    """(task_id, node, seed, rank): the nodes near a task's seeds, by a walk that restarts at them. seed is the place among the
    seeds, null for others; rank is rounded to nine digits.

    Seeds are the nodes with the highest hits (task_id, node, score), ties by name. Edges are walked both ways, each neighbour
    once, and only between near nodes; a node without any gives its mass to the seeds by their share of it.
    """
    with wide(hits.sparkSession, edges.count() + hits.count()):
        return _walked(hits, edges, seeds, hops, iterations, restart)


def _walked(hits: DataFrame, edges: DataFrame, seeds: int, hops: int, iterations: int, restart: float) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "node"))
    chosen = hits.filter("score > 0").groupBy("task_id", "node").agg(F.max("score").alias("score")).withColumn("seed", place).filter(F.col("seed") <= seeds)
    total = F.sum("score").over(Window.partitionBy("task_id"))
    chosen = written(chosen.select("task_id", "node", "seed", (F.col("score") / total).alias("p")), "seeds")
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = written(both, "edges")
    near = _near(chosen, both, hops)
    inside = near.join(both, near["node"] == both["a"]).select("task_id", "a", "b").join(near.withColumnRenamed("node", "b"), ["task_id", "b"], "left_semi")
    degree = inside.groupBy("task_id", "a").agg(F.count("*").alias("d"))
    links = written(inside.join(degree, ["task_id", "a"]), "links")
    start = written(near.join(chosen, ["task_id", "node"], "left").join(degree.withColumnRenamed("a", "node"), ["task_id", "node"], "left").select("task_id", "node", "seed", F.coalesce("p", F.lit(0.0)).alias("p"), F.col("d").isNull().alias("end")), "start")
    now = start.withColumn("rank", F.col("p"))
    for i in range(iterations):
        moved = links.join(now.select("task_id", F.col("node").alias("a"), "rank"), ["task_id", "a"]).groupBy("task_id", F.col("b").alias("node")).agg(F.sum((1 - restart) * F.col("rank") / F.col("d")).alias("m"))
        lost = now.filter("end").groupBy("task_id").agg(F.sum((1 - restart) * F.col("rank") * F.lit(1.0)).alias("lost"))
        met = start.join(moved, ["task_id", "node"], "left").join(lost, "task_id", "left")
        now = met.select("task_id", "node", "seed", "p", "end", (restart * F.col("p") + F.coalesce("m", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) * F.col("p")).alias("rank"))
        if i % 4 == 3 or i == iterations - 1:
            now = written(now, "ranks")
    return now.select("task_id", "node", "seed", F.round("rank", 9).alias("rank"))


def task_views(hits: DataFrame, edges: DataFrame, most_nodes: int = 12, most_edges: int = 16, most_reached: int = 6, most_paths: int = 2, **walk) -> DataFrame:
    """(task_id, part, place, node, a, b, kind): a task's nodes (seeds first, then by rank), the edges between them, what is up-
    and downstream of its seeds, and paths seed, target, tail along calls, each list best first and of bounded length.

    Edges are (a, b, kind, resolved). Those shown come calls first, then imports, then by name; upstream, downstream and
    paths follow shown, resolved edges only, so that nothing hangs on what isn't there. What is reached comes by distance up to
    two, then name; a path takes the least of its target's tails, and stops there if it has none. node is the path's end, a its seed, b
    its target. Tasks without hits have no rows.
    """
    ranks = ranked_nodes(hits, edges, **walk)
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.asc_nulls_last("seed"), F.desc("rank"), "node"))
    nodes = written(ranks.withColumn("place", place).filter(F.col("place") <= most_nodes).select("task_id", "node", "seed", "place"), "nodes")
    own = edges.groupBy("a", "b", "kind").agg(F.max(F.coalesce("resolved", F.lit(False))).alias("resolved"))
    ends = nodes.select("task_id", F.col("node").alias("a")).join(own, "a").join(nodes.select("task_id", F.col("node").alias("b")), ["task_id", "b"])
    turn = F.row_number().over(Window.partitionBy("task_id").orderBy(lookup(F.col("kind"), SHOWN, len(SHOWN)), "a", "b", "kind"))
    shown = written(ends.withColumn("place", turn).filter(F.col("place") <= most_edges), "shown")
    seeds = nodes.filter("seed is not null")
    strong = shown.filter(F.col("resolved") & F.col("kind").isin("imports", "calls")).select("task_id", "a", "b").distinct()

    def reached(part: str, start: str, end: str) -> DataFrame:
        step = strong.select("task_id", F.col(start).alias("from"), F.col(end).alias("to"))
        first = seeds.select("task_id", F.col("node").alias("from")).join(step, ["task_id", "from"]).select("task_id", F.col("to").alias("node"), F.lit(1).alias("far"))
        second = first.select("task_id", F.col("node").alias("from")).join(step, ["task_id", "from"]).select("task_id", F.col("to").alias("node"), F.lit(2).alias("far"))
        best = first.union(second).groupBy("task_id", "node").agg(F.min("far").alias("far")).join(seeds.select("task_id", "node"), ["task_id", "node"], "left_anti")
        at = F.row_number().over(Window.partitionBy("task_id").orderBy("far", "node"))
        return best.withColumn("place", at).filter(F.col("place") <= most_reached).select("task_id", F.lit(part).alias("part"), "place", "node", *_nothing())

    calls = shown.filter(F.col("resolved") & (F.col("kind") == "calls")).select("task_id", "a", "b")
    first = calls.join(seeds.select("task_id", F.col("node").alias("a"), "seed"), ["task_id", "a"])
    after = calls.select("task_id", F.col("a").alias("b"), F.col("b").alias("tail"))
    paths = first.join(after, ["task_id", "b"], "left").groupBy("task_id", "seed", "a", "b").agg(F.min(F.when((F.col("tail") != F.col("a")) & (F.col("tail") != F.col("b")), F.col("tail"))).alias("tail"))
    nth = F.row_number().over(Window.partitionBy("task_id").orderBy("seed", "b"))
    paths = paths.withColumn("place", nth).filter(F.col("place") <= most_paths)
    node_type = edges.schema["a"].dataType
    out = [
        nodes.select("task_id", F.when(F.col("seed").isNotNull(), "seed").otherwise("node").alias("part"), "place", "node", *_nothing()),
        shown.select("task_id", F.lit("edge").alias("part"), "place", F.lit(None).cast(node_type).alias("node"), "a", "b", "kind"),
        reached("upstream", "b", "a"), reached("downstream", "a", "b"),
        paths.select("task_id", F.lit("path").alias("part"), "place", F.coalesce("tail", "b").alias("node"), "a", "b", F.lit("calls").alias("kind")),
    ]
    rows = out[0]
    for part in out[1:]:
        rows = rows.union(part)
    return rows


def _nothing() -> list:
    return [F.lit(None).alias(c) for c in ("a", "b", "kind")]
