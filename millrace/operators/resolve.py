"""Joins that resolve a name to what it stands for: staged, with uniqueness and limits on ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.sources.tables import written


def modules(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(spec, path) for dotted names: the module of that very name, else the only one that ends in it.

    files has (path, module). All suffixes at dots are made once; those that several paths share resolve nothing."""
    exact = specs.select("spec").distinct().join(files.groupBy(F.col("module").alias("spec")).agg(F.min("path").alias("path")), "spec")
    parts = F.split("module", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    only = files.select("path", F.explode(suffixes).alias("spec")).distinct().groupBy("spec").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")
    rest = specs.select("spec").distinct().join(exact.select("spec"), "spec", "left_anti").join(only, "spec")
    return exact.select("spec", "path", F.lit("exact").alias("how")).union(rest.select("spec", "path", F.lit("suffix").alias("how")))


def name_edges(uses: DataFrame, defined: DataFrame, most: int = 3, shortest: int = 3) -> DataFrame:
    """(source, target, name, status): a use (path, name) of a name that at most `most` other files (path, name) define.

    One definition resolves the edge, several make candidates. Names that the user defines, or short ones, give none."""
    d = defined.select("path", "name").distinct().filter(F.length("name") >= shortest)
    few = d.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    targets = d.join(few, "name").select(F.col("path").alias("target"), "name", "n")
    own = uses.select("path", "name").distinct().join(d, ["path", "name"], "left_anti").withColumnRenamed("path", "source")
    return own.join(targets, "name").select("source", "target", "name", F.when(F.col("n") == 1, "resolved").otherwise("candidate").alias("status"))


def aliases(before: DataFrame, after: DataFrame, renames: DataFrame) -> DataFrame:
    """(old_path, new_path, name, state) of symbols (path, name, kind, fingerprint) through renames (old_path, new_path):
    the same content supports the alias, other content leaves it uncertain."""
    a = before.select(F.col("path").alias("old_path"), "name", "kind", F.col("fingerprint").alias("was"))
    b = after.select(F.col("path").alias("new_path"), "name", "kind", F.col("fingerprint").alias("now"))
    met = a.join(renames, "old_path").join(b, ["new_path", "name", "kind"])
    return met.select("old_path", "new_path", "name", F.when(F.col("was") == F.col("now"), "supported").otherwise("uncertain").alias("state"))


def bound(operations: DataFrame, instances: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The healthiest instance for each operation: instances (instance, health, access, keys...) whose access level
    suffices, by health, then name. An operation (operation, needs, keys...) that none serves has a null instance.

    Both are put in one order, by keys and falling level, in which an operation's best is the least of the instances before
    it; so no pairs are made. Rows are dealt by ranges of that order, and what comes before a range is added to it, so that
    keys of any size are shared among tasks. There are as many ranges as shuffle partitions, if not told otherwise.
    """
    parts = parts or int(operations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offered, none = F.struct("health", "instance"), F.lit(None)
    held = instances.filter("access is not null").select(*keys, F.col("access").alias("__level"), offered.alias("__x"), F.lit(0).alias("__asks"), none.cast(operations.schema["operation"].dataType).alias("operation"))
    asks = operations.filter("needs is not null and operation is not null").select(*keys, F.col("needs").alias("__level"), none.alias("__x"), F.lit(1).alias("__asks"), "operation")
    order = (F.desc("__level"), F.col("__asks"))
    rows = held.unionByName(asks).dropna(subset=keys)
    dealt = written(rows.repartitionByRange(parts, *keys, *order, "operation").withColumn("__part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*keys, "__part").agg(F.min("__x").alias("__x")).withColumn("__before", F.min("__x").over(past)).drop("__x")
    own = dealt.withColumn("__own", F.min("__x").over(within)).filter("__asks = 1")
    best = own.join(before, [*keys, "__part"]).groupBy("operation").agg(F.min(F.least("__own", "__before")).alias("x"))
    return operations.select("operation").join(best, "operation", "left").select("operation", F.col("x.instance").alias("instance"), F.col("x.health").alias("health"))


def stale_claims(claims: DataFrame, current: DataFrame) -> DataFrame:
    """(claim_id, stale): a claim is stale if any file it cites (claim_id, path, sha) has another content now, or none."""
    met = claims.join(current.select("path", F.col("sha").alias("now")), "path", "left")
    return met.groupBy("claim_id").agg(F.max(~F.col("sha").eqNullSafe(F.col("now"))).alias("stale"))


def siblings(files: DataFrame, seeds: DataFrame, known: DataFrame) -> DataFrame:
    """(path, other): what else is known in the folder of each seed. Only known files join, so that a large folder
    is never paired with itself; a seed's folder meets the known ones once."""
    a = seeds.select("path").join(files, "path").select("path", "folder")
    b = known.select("path").join(files, "path").select(F.col("path").alias("other"), "folder")
    return a.join(b, "folder").filter("path <> other").select("path", "other")


def contained(spans: DataFrame, group: str) -> DataFrame:
    """Spans (group, lo, hi) that lie in no other of their group. By start and falling end, a span lies in an earlier one
    if some earlier end reaches its own: one running maximum, no pairs. Equal spans count once."""
    one = spans.select(group, "lo", "hi").distinct()
    order = Window.partitionBy(group).orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("reach", F.max("hi").over(order)).filter("reach is null or reach < hi").drop("reach")


def merged(spans: DataFrame, group: str) -> DataFrame:
    """Overlapping or touching half-open spans as one, with how many they were. Equal spans are counted first, so that no
    order of equal rows can part them."""
    order = Window.partitionBy(group).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.groupBy(group, "lo", "hi").agg(F.count("*").alias("n")).withColumn("new", (reach.isNull() | (reach < F.col("lo"))).cast("int"))
    islands = starts.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("island")
