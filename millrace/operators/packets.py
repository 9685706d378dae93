"""Choosing what goes into a bounded packet: caps, shares, budgets and trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.sources.tables import written


def prefix_sums(rows: DataFrame, group: str, order: str, size: str, parts: int | None = None) -> DataFrame:
    """Adds `used`: the sum of `size` up to each row of its group, by order (no ties within a group)."""
    return running_sums(rows, group, order, {"used": size}, parts)


def running_sums(rows: DataFrame, group: str, order: str, sizes: dict[str, str], parts: int | None = None) -> DataFrame:
    """Adds the sum of each size up to each row of its group, by order (no ties within a group), under the name given.

    Rows are dealt by ranges of group and order, once for all sums, so a group of any size is shared among tasks; each task
    sums its own part, and the sums of the parts before it, one row for a group and part, are added. The parts are written
    first, so that a task that runs again sees the same. There are as many parts as shuffle partitions, if not told otherwise.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, group, order).withColumn("__part", F.spark_partition_id()), "ranges")
    mine = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(*(F.sum(size).alias(f"__s_{name}") for name, size in sizes.items()))
    offsets = sums.select("__g", "__p", *(F.coalesce(F.sum(f"__s_{name}").over(past), F.lit(0)).alias(f"__b_{name}") for name in sizes))
    own = dealt.withColumns({f"__o_{name}": F.sum(size).over(mine) for name, size in sizes.items()})
    met = own.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return met.select(*rows.columns, *((F.col(f"__o_{name}") + F.col(f"__b_{name}")).alias(name) for name in sizes))


def known_before(rows: DataFrame, group: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Adds `earlier` and `best_before`: how many rows of its group come before each row, by order (no ties within a group),
    and the greatest known value among them. Rows are dealt by ranges as in `prefix_sums`."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, group, order).withColumn("__part", F.spark_partition_id()), "ranges")
    mine = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__n", F.count(F.lit(1)).over(mine)).withColumn("__m", F.max(value).over(mine))
    past = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("c"), F.max(value).alias("m"))
    before = sums.select("__g", "__p", F.coalesce(F.sum("c").over(past), F.lit(0)).alias("__c"), F.max("m").over(past).alias("__b"))
    met = own.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return met.withColumn("earlier", F.col("__n") + F.col("__c")).withColumn("best_before", F.greatest("__m", "__b")).drop("__n", "__m", "__c", "__b", "__part", "__g", "__p")


def chosen_files(ranked: DataFrame, key: str, most: int, most_of_kind: int) -> DataFrame:
    """(query_id, key, rank, state) for ranked (query_id, key, rank, limited, content).

    In rank order a file is chosen while there is room, unless its content was chosen already or it is of the limited
    kind and that has its share. Those held back then fill what room is left. A query's list is short (a candidate
    limit), so it is folded in one row.
    """
    xs = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k"), "limited", "content"))).alias("xs"))
    kind = "array<struct<k:bigint,rank:int,state:string>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lim"), F.array().cast("array<string>").alias("seen"), F.array().cast(kind).alias("out"))

    def step(a, x):
        full, again = a["n"] >= most, x["content"].isNotNull() & F.array_contains(a["seen"], F.coalesce(x["content"], F.lit("")))
        state = F.when(full, "file limit").when(again, "held: same content").when(x["limited"] & (a["lim"] >= most_of_kind), "held: share").otherwise("chosen")
        taken = (state == "chosen").cast("int")
        seen = F.when((taken == 1) & x["content"].isNotNull(), F.array_append(a["seen"], x["content"])).otherwise(a["seen"])
        row = F.struct(x["k"].cast("long").alias("k"), x["rank"].cast("int").alias("rank"), state.alias("state"))
        return F.struct((a["n"] + taken).alias("n"), (a["lim"] + taken * x["limited"].cast("int")).alias("lim"), seen.alias("seen"), F.array_append(a["out"], row).alias("out"))

    rows = xs.select("query_id", F.inline(F.aggregate("xs", start, step, lambda a: a["out"])))
    mine = Window.partitionBy("query_id")
    held = F.col("state").startswith("held")
    room = most - F.sum((F.col("state") == "chosen").cast("int")).over(mine)
    turn = F.sum(held.cast("int")).over(mine.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    filled = rows.withColumn("room", room).withColumn("turn", turn)
    return filled.select("query_id", F.col("k").alias(key), "rank", F.when(held & (F.col("turn") <= F.col("room")), "refilled").otherwise(F.col("state")).alias("state"))


def strongest_relations(edges: DataFrame, near: DataFrame, kinds: list[str], most: int = 4) -> DataFrame:
    """(path, other, kind, place): for each neighbour that is near (other, rank) its strongest kind of edge
    (path, other, kind), kinds being in falling strength; the `most` nearest a path."""
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    best = edges.filter(order > 0).groupBy("path", "other").agg(F.min_by("kind", order).alias("kind")).join(near, "other")
    place = F.row_number().over(Window.partitionBy("path").orderBy("rank", "other"))
    return best.withColumn("place", place).filter(F.col("place") <= most).select("path", "other", "kind", "place")


def trimmed(parts: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Parts left when whole parts go, by rising order, until the rest fits: a part goes if it and all after it are too much."""
    rest = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing))
    return parts.withColumn("rest", rest).filter(F.col("rest") <= budget).drop("rest")


def diversified(ranked: DataFrame, key: str, folder: str, most: int, cap: int) -> DataFrame:
    """(query_id, key, folder, reason): by rank, at most `cap` of a folder and `most` in all; then the best of each folder
    that has none. A folder's place depends on that folder alone, so windows give what a loop would."""
    within = F.row_number().over(Window.partitionBy("query_id", folder).orderBy("rank"))
    fits = ranked.withColumn("__in", within).withColumn("ok", F.col("__in") <= cap)
    nth = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    picked = fits.withColumn("main", F.col("ok") & (nth <= most))
    covered = F.max("main").over(Window.partitionBy("query_id", folder))
    reason = F.when(F.col("main"), "rank").when(~covered & (F.col("__in") == 1), "uncovered folder")
    return picked.select("query_id", key, folder, reason.alias("reason")).filter("reason is not null")


def delivered(parts: DataFrame, packet: str, kind: str, order: str, size: str, protected: str, budget: int, classes: list[tuple[str, float, int]]) -> DataFrame:
    """Adds state to the parts of each packet: protected, delivered, omitted or minimum.

    classes are (kind, share, least) in order of priority; shares of the room that protected parts leave are reserved, rounded
    down. A class takes its parts in order (no ties within a packet's class) up to what was reserved for it and left over by
    those before, and its first `least` parts even beyond that, as far as the packet has room, at the cost of classes after it. A
    part that doesn't fit ends its class. If the protected parts alone are over the budget, all others are omitted, and the
    protected ones are minimum. Null sizes are 0, kinds without a class are omitted. A class of any size is summed in ranges.
    """
    rows = parts.withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("double")).withColumn("__kept", F.coalesce(F.col(protected), F.lit(False)))
    room = F.lit(float(budget)) - F.coalesce(F.sum(F.when(F.col("__kept"), F.col("__size"))), F.lit(0.0))
    rooms = written(rows.groupBy(F.col(packet).alias("__id")).agg(room.alias("room")), "rooms")
    open_ = rows.filter(~F.col("__kept")).withColumn("__class", F.struct(F.col(packet).alias("id"), F.col(kind).alias("kind"))).withColumn("__one", F.lit(1))
    summed = written(running_sums(open_, "__class", order, {"__place": "__one", "__upto": "__size"}).drop("__class", "__one"), "sums")
    now = rooms.filter("room >= 0").select("__id", "room", F.lit(0.0).alias("reserved"), F.lit(0.0).alias("spent"))
    taken = None
    for name, share, least in classes:
        own = summed.filter(F.col(kind) == name)
        held = own.join(now, F.col(packet).eqNullSafe(F.col("__id")))
        free = F.col("reserved") + F.floor(F.lit(share) * F.col("room")) - F.col("spent")
        fits = (F.col("__upto") <= free) | ((F.col("__place") <= least) & (F.col("__upto") <= F.col("room") - F.col("spent")))
        got = held.filter(fits)
        limit = got.groupBy(F.col("__id").alias("__of")).agg(F.max("__upto").alias("used"), F.max("__place").alias("last"))
        met = now.join(limit, F.col("__id").eqNullSafe(F.col("__of")), "left")
        now = written(met.select("__id", "room", (F.col("reserved") + F.floor(F.lit(share) * F.col("room"))).alias("reserved"), (F.col("spent") + F.coalesce("used", F.lit(0.0))).alias("spent")), "spent")
        ends = limit.select("__of", F.lit(name).alias("__kind"), F.col("last").cast("long").alias("last"))
        taken = ends if taken is None else taken.union(ends)
    ends = written(taken, "ends")
    met = summed.join(ends, F.col(packet).eqNullSafe(F.col("__of")) & (F.col(kind) == F.col("__kind")), "left")
    rest = met.withColumn("state", F.when(F.col("__place") <= F.col("last"), "delivered").otherwise("omitted")).select(*parts.columns, "state")
    kept = rows.filter("__kept").join(rooms, F.col(packet).eqNullSafe(F.col("__id"))).withColumn("state", F.when(F.col("room") < 0, "minimum").otherwise("protected"))
    return rest.unionByName(kept.select(*parts.columns, "state"))
