"""Connected components by minimum labels with pointer jumping, all in joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.sources.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the edges (a, b); root is the least node that it is connected with.

    Each round takes the least label of the neighbours, then the label of that label, so that paths halve. It ends
    when nothing changes. No edges give no rows.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        met = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        far = labels.select(F.col("node").alias("at"), F.col("root").alias("further"))
        now = written(met.join(far, F.col("root") == F.col("at")).select("node", "was", F.least("root", "further").alias("root")), "labels")
        if not now.filter("was <> root").limit(1).count():
            return now.select("node", "root")
        labels = now.select("node", "root")
