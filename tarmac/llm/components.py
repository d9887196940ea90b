"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import forget, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long), any direction, repeats allowed -> (node, root).

    ``root`` is the smallest node reachable; a root is a node too.  Only nodes with an edge
    to another node are returned.  Each round joins every node with the least of its neighbours (large star:
    larger neighbours move to it; small star: smaller ones do), which ends after a number
    of rounds logarithmic in the size of a component.  Minima are combined before the
    shuffle, and each round is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                  .distinct(), "edges")
    mark = None
    while True:
        # Large star: every larger neighbour of a node goes to the least neighbour.
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where(b > a).join(least, "a").where(b != F.col("m"))
                 .select(b.alias("a"), F.col("m").alias("b")).distinct())
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = written(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if seen == mark:
            roots = now.select(b.alias("node"), b.alias("root")).distinct()
            return now.select(a.alias("node"), b.alias("root")).unionByName(roots)
        mark = seen
