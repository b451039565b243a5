"""Connected components of an edge table by alternating large and small stars.

Every round is two shuffles of the edge table, cut off by a table in the shared folder; the number
of rounds grows with the logarithm of the graph's diameter. Minima are combined before the shuffle,
so a node of very many neighbours costs one row per task, and joins on it can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of the component as root, for each node of ``edges`` (a, b: long). Null ends
    and loops make no edge; an empty table has no nodes."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = table(edges, "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = table(small.filter("a <> b").distinct(), "edges")
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
