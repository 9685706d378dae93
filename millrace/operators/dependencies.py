"""What a capability needs: all of some, one of each group, some only for an operation, some at will."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.sources.tables import join_hot, shuffled, written

#: Relations of a row of needs (name, dep, relation, grp, operation).
ALL, ANY, OPTIONAL, CONDITIONAL = "all_of", "any_of", "optional", "conditional"


def _required(operation: str | None) -> Column:
    return (F.col("relation") == ALL) | ((F.col("relation") == CONDITIONAL) & (F.col("operation") == F.lit(operation)))


def own_conditions(needs: DataFrame, names: DataFrame, states: DataFrame, operation: str | None) -> DataFrame:
    """(name, kind, item) of what each name lacks by its own needs: kind is missing, unknown or optional.

    A required dependency that is neither named nor has a state is missing. A group counts as its best member: available if one
    is, missing if all are, unknown else. A null state, or none for a name, is unknown.
    """
    states = states.select(F.col("name").alias("dep"), F.coalesce("state", F.lit("unknown")).alias("state")).groupBy("dep").agg(F.min("state").alias("state"))
    known = names.select(F.col("name").alias("dep"), F.lit(True).alias("named")).distinct()
    deps = written(needs.select("dep").distinct().join(known, "dep", "left").join(states, "dep", "left").select("dep", F.coalesce("state", F.when(F.col("named"), "unknown").otherwise("missing")).alias("state")), "states")
    held = needs.groupBy("dep").agg(F.count("*").alias("__held"))
    rows = join_hot(needs, written(deps.join(held, "dep"), "states"), "dep", "__held").drop("__held")
    lacking = F.col("state").isin("missing", "unknown")
    single = rows.filter(_required(operation) & lacking).select("name", F.col("state").alias("kind"), F.col("dep").alias("item"))
    at_will = rows.filter((F.col("relation") == OPTIONAL) & (F.col("state") == "missing")).select("name", F.lit("optional").alias("kind"), F.col("dep").alias("item"))
    groups = rows.filter(F.col("relation") == ANY).groupBy("name", "grp").agg(F.max((F.col("state") == "available").cast("int")).alias("good"), F.min((F.col("state") == "missing").cast("int")).alias("bad"))
    group = groups.filter("good = 0").select("name", F.when(F.col("bad") == 1, "missing").otherwise("unknown").alias("kind"), F.concat(F.lit("any_of:"), F.coalesce(F.col("grp").cast("string"), F.lit(""))).alias("item"))
    return single.withColumn("item", F.col("item").cast("string")).union(group).union(at_will.withColumn("item", F.col("item").cast("string")))


_KINDS = ("missing", "unknown", "optional")


def dependency_states(needs: DataFrame, names: DataFrame, states: DataFrame, operation: str | None = None) -> DataFrame:
    """(name, status, first_missing, first_unknown, first_optional) of every name.

    A name lacks what it lacks itself and what the named ones among its required dependencies do, however far down. status is
    cycle if a cycle can be reached that way, else missing, unknown, degraded (something at will is missing) or satisfied; first_*
    is the least item of a kind, null for names that reach a cycle. Names are settled from the ends of the graph upwards, each
    once all it requires is settled, and only their messages move; what is never settled reaches a cycle. A self-reference is a
    cycle, repeated needs count once, and needs of names that aren't listed, or of nothing (a null dep), have no effect.
    """
    names = names.select("name").filter("name is not null").distinct()
    needs = written(needs.select("name", "dep", "relation", "grp", "operation").filter("dep is not null").distinct().join(names, "name", "left_semi"), "needs")
    own = own_conditions(needs, names, states, operation).groupBy("name").agg(*(F.min(F.when(F.col("kind") == k, F.col("item"))).alias(k) for k in _KINDS))
    edges = needs.filter(_required(operation)).select("name", "dep").distinct().join(names.withColumnRenamed("name", "dep"), "dep", "left_semi")
    edges = written(edges, "edges")
    held = written(edges.groupBy("dep").agg(F.count("*").alias("__held")), "held")
    degrees = edges.groupBy("name").agg(F.count("*").alias("degree"))
    every = written(names.join(degrees, "name", "left").join(own, "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"), *_KINDS), "names")
    front = every.filter("degree = 0").select("name", *_KINDS)
    settled, waiting = [front], None
    with shuffled(edges.sparkSession):
        while True:
            told = front.withColumnRenamed("name", "dep").join(held, "dep")
            told = written(told, "front")
            if not told.limit(1).count():
                break
            met = join_hot(edges, told, "dep", "__held")
            news = met.groupBy("name").agg(F.count("*").alias("n"), *(F.min(k).alias(k) for k in _KINDS))
            if waiting is not None:
                news = news.unionByName(waiting).groupBy("name").agg(F.sum("n").alias("n"), *(F.min(k).alias(k) for k in _KINDS))
            news = written(news.join(every.select("name", "degree", *(F.col(k).alias(f"own_{k}") for k in _KINDS)), "name"), "news")
            waiting = news.filter("n < degree").select("name", "n", *_KINDS)
            front = news.filter("n = degree").select("name", *(F.least(k, f"own_{k}").alias(k) for k in _KINDS))
            settled.append(front)
    done = settled[0]
    for part in settled[1:]:
        done = done.union(part)
    done = done.withColumn("settled", F.lit(True))
    status = F.when(F.col("settled").isNull(), "cycle").when(F.col("missing").isNotNull(), "missing").when(F.col("unknown").isNotNull(), "unknown").when(F.col("optional").isNotNull(), "degraded").otherwise("satisfied")
    return names.join(done, "name", "left").select("name", status.alias("status"), *(F.col(k).alias(f"first_{k}") for k in _KINDS))


def dependency_items(roots: DataFrame, needs: DataFrame, names: DataFrame, states: DataFrame, operation: str | None = None) -> DataFrame:
    """(name, kind, item), each once, of all that the asked roots lack, their own and what lies below, cycles included.

    Rows grow with the roots and all that each of them requires; ask for the few that are looked at.
    """
    listed = names.select("name").filter("name is not null").distinct()
    own = written(own_conditions(needs.filter("dep is not null").distinct().join(listed, "name", "left_semi"), names, states, operation).withColumnRenamed("name", "at"), "conditions")
    edges = written(needs.filter(_required(operation)).select(F.col("name").alias("at"), "dep").distinct().join(listed.withColumnRenamed("name", "dep"), "dep", "left_semi"), "edges")
    front = written(roots.select("name").distinct().join(listed, "name", "left_semi").select("name", F.col("name").alias("at")), "reached")
    parts = seen = front
    while True:
        new = written(front.join(edges, "at").select("name", F.col("dep").alias("at")).distinct().join(seen, ["name", "at"], "left_anti"), "reached")
        if not new.limit(1).count():
            break
        parts, front = parts.union(new), new
        seen = parts
    return parts.join(own, "at").select("name", "kind", "item").distinct()
