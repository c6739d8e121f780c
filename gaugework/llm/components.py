"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a long, b long) can reach.

    Star contraction: in turn, each node hands its larger, then its smaller neighbours to the least of them, until nothing
    changes; each round moves some edge to a smaller node, so it ends. An edge list never grows. Minima are summed up before their exchange and written before they are joined, so
    Spark can split a node of many neighbours between tasks. Loops and repeated edges do no harm; no edges, no rows.
    """
    spark = edges.sparkSession
    now = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(spark, large.groupBy("a").agg(F.min("b").alias("m")), "least")
        handed = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = handed.unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = written(spark, new, "edges", finished=[now, least, small])
        # finished when each node has one edge and no target has an edge itself
        if now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() == 0 and now.groupBy("a").count().filter("count > 1").limit(1).count() == 0:
            labels = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            return written(spark, labels, "components", finished=[now])
