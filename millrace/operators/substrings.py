"""Substring search for many patterns at once, by the rarest run of three characters of each pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.sources.tables import join_hot, written

#: Patterns that stand in one row of a run, about; more take several rows.
PATTERNS_PER_LIST = 1000


def grams(text: Column, width: int) -> Column:
    """The distinct runs of `width` characters of a text; none if it is shorter. Linear in the text."""
    letters = run = F.filter(F.split(text, ""), lambda x: x != "")
    for k in range(2, width + 1):
        run = F.zip_with(run, F.slice(letters, F.lit(k), F.greatest(F.size(letters), F.lit(1))), lambda a, b: F.concat(a, b))  # null past the end
    return F.array_distinct(F.array_compact(run))


def containing(names: DataFrame, name: str, patterns: DataFrame, pattern: str, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Each distinct pattern with the rows of names whose `name` contains it; with `most`, the first by length, name and `order`.

    A pattern asks for the one of its runs of three characters that the fewest names have, or for itself if it is shorter, and
    what has that is checked. Distinct names are indexed by the asked runs alone. A run that a third of all names have is
    shared among tasks. Null and empty patterns, and null names, give nothing.
    """
    asked = patterns.select(F.col(pattern).alias("__p")).filter("__p <> ''").distinct()
    own = names.select(F.col(name).alias("__n")).filter("__n is not null").distinct()
    width = F.least(F.length("__p"), F.lit(3))
    of = F.when(width == 1, grams(F.col("__p"), 1)).when(width == 2, grams(F.col("__p"), 2)).otherwise(grams(F.col("__p"), 3))
    wanted = written(asked.select("__p", F.explode(of).alias("gram")), "asked")
    widths = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())  # three at most; texts are cut by those alone
    every = F.concat(*(grams(F.col("__n"), k) for k in widths or [1]))
    held = written(own.select("__n", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"), "grams")
    counts = held.groupBy("gram").agg(F.count("*").alias("__held"))
    least = F.min(F.struct("__held", "gram")).alias("least")
    rarest = wanted.join(counts, "gram").groupBy("__p").agg(least, F.count("*").alias("found")).join(wanted.groupBy("__p").agg(F.count("*").alias("all")), "__p")
    # A pattern with a run that no name has is in no name.
    chosen = written(rarest.filter("found = all").select("__p", "least.gram", "least.__held"), "chosen")
    sizes = chosen.groupBy("gram").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("__p"), F.ceil(F.col("n") / PATTERNS_PER_LIST))
    lists = chosen.join(sizes, "gram").groupBy("gram", block.alias("block")).agg(F.first("__held").alias("__held"), F.collect_list("__p").alias("__ps"))
    met = join_hot(held, written(lists, "lists"), "gram", "__held").select("__n", F.explode("__ps").alias("__p")).filter(F.contains("__n", "__p"))
    rows = names.join(met, F.col(name) == F.col("__n")).drop("__n")
    if most is not None:
        best = Window.partitionBy("__p").orderBy(F.length(name), name, *(order or []))
        rows = rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    return rows.withColumnRenamed("__p", pattern)
