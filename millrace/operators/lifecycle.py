"""State of builds, revisions, caches and budgets over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def without_prefixes(rows: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """Rows whose path is none of the prefixes and in no folder of them. The prefixes are a short list of a caller."""
    for prefix in prefixes:
        rows = rows.filter((F.col(path) != prefix) & ~F.col(path).startswith(prefix + "/"))
    return rows


def reusable(files: DataFrame, cache: DataFrame, shards: int = 16) -> DataFrame:
    """(path, sha, shard, reused): a record is reused where the cache has the path with the same content."""
    shard = F.conv(F.substring("sha", 1, 4), 16, 10).cast("int") % shards
    known = cache.select("path", "sha").distinct().withColumn("reused", F.lit(True))
    return files.join(known, ["path", "sha"], "left").select("path", "sha", shard.alias("shard"), F.coalesce("reused", F.lit(False)).alias("reused"))


def remaining_work(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted build has still to do: files without a record in the generation that is being built."""
    return files.join(done.filter("state = 'building'").select(key).distinct(), key, "left_anti")


def eligible_revisions(events: DataFrame, now: Column, uses: DataFrame) -> DataFrame:
    """(revision, state) by the last event (revision, seq, state, expires, most_uses); a canary that is out of time or has
    been used up is expired."""
    last = events.groupBy("revision").agg(F.max(F.struct("seq", "state", "expires", "most_uses")).alias("last"))
    met = last.join(uses, "revision", "left")
    over = (F.col("last.expires") < now) | (F.coalesce("uses", F.lit(0)) >= F.col("last.most_uses"))
    return met.select("revision", F.when((F.col("last.state") == "canary") & over, "expired").otherwise(F.col("last.state")).alias("state"))


def kept_by_use(entries: DataFrame, owner: str, used: str, key: str, most: int) -> DataFrame:
    """The `most` last used entries of each owner; ties go to the key."""
    order = Window.partitionBy(owner).orderBy(F.desc(used), key)
    return entries.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def supported(revisions: DataFrame, evidence: DataFrame, forgotten: DataFrame, key: str) -> DataFrame:
    """Revisions with withdrawn: whether any evidence they cite has been forgotten. evidence is (key, source)."""
    gone = evidence.join(forgotten.select("source").distinct(), "source", "left_semi").select(key).distinct().withColumn("withdrawn", F.lit(True))
    return revisions.join(gone, key, "left").withColumn("withdrawn", F.coalesce("withdrawn", F.lit(False)))


def allotted(rows: DataFrame, group: str, order: list[Column], need: str, budget: int) -> DataFrame:
    """Adds given: bytes for each row of a group from a common budget.

    First every row gets its equal share or less, then the rest goes in order to rows that need more. A group's rows are
    a short ranked list.
    """
    whole, by_rank = Window.partitionBy(group), Window.partitionBy(group).orderBy(*order)
    share = F.floor(F.lit(budget) / F.count("*").over(whole)).cast("long")
    first = rows.withColumn("first", F.least(share, F.col(need)))
    rest = first.withColumn("left", budget - F.sum("first").over(whole)).withColumn("more", F.col(need) - F.col("first"))
    before = F.coalesce(F.sum("more").over(by_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = F.col("first") + F.greatest(F.lit(0), F.least(F.col("more"), F.col("left") - before))
    return rest.withColumn("given", given.cast("long")).drop("first", "left", "more")


def fitted(lines: Column, centre: Column, most: int) -> Column:
    """(first, last) of the lines around `centre` that fit into `most` characters, line ends included: a line before and a
    line after in turn, as long as the next one fits. lines is an array, centre counts from 0."""

    def grow(state: Column, _: Column) -> Column:
        size = lambda i: F.coalesce(F.length(F.get(lines, i)) + 1, F.lit(0))
        up, down = size(state["first"] - 1), size(state["last"] + 1)
        can_up = (state["first"] > 0) & (state["used"] + up <= most)
        used = state["used"] + F.when(can_up, up).otherwise(0)
        can_down = (state["last"] < F.size(lines) - 1) & (used + down <= most)
        return F.struct((state["first"] - can_up.cast("int")).alias("first"), (state["last"] + can_down.cast("int")).alias("last"), (used + F.when(can_down, down).otherwise(0)).alias("used"))

    begun = F.struct(centre.cast("int").alias("first"), centre.cast("int").alias("last"), (F.length(F.get(lines, centre)) + 1).alias("used"))
    # No window has more lines than characters, and each step adds one on either side.
    return F.aggregate(F.sequence(F.lit(1), F.least(F.size(lines), F.lit(most))), begun, grow, lambda s: F.struct(s["first"], s["last"]))
