"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.runtime import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node reachable.

    ``links`` has columns ``a`` and ``b`` of one type. Each round is two aggregates over the
    links; the number of rounds is logarithmic in the longest chain.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            lower.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        after = cut_lineage(small)
        changed = after.exceptAll(edges).union(edges.exceptAll(after)).limit(1).count()
        edges = after
        if not changed:
            roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
