"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.sources.shared import stored


def clusters(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cluster): the least node that links (a, b) join each of ``nodes`` (node) to; a node without links is its own.

    A round hangs the larger neighbours of each node on its least one, then the smaller ones; it is two shuffles of the links. Rounds
    grow with the logarithm of the longest path. Least neighbours are found before the shuffle, so a node of very many links sends a row from each task,
    and the joins on it have a shuffle on both sides, which Spark can split.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = large.join(low, F.col("a") == F.col("c")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(low.select(F.col("c").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        sums = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == seen:
            break
        seen = sums
    roots = edges.groupBy("a").agg(F.min("b").alias("b"))
    return nodes.join(roots, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("cluster"))
