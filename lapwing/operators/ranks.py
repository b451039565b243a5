"""Exact ranks and prefix positions of shuffled rows without a single-task window per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, groups: list[str], order: Column, rows: int | None = None, per_bucket: int = 20_000) -> DataFrame:
    """``df`` with ``rank`` (from 1) of each row of its group by ``order`` (hex md5; ties are equal rows' own affair) and ``group_rows``.

    Groups of any size: rows are ranked inside buckets of the hash's first digits, and bucket counts, a small
    table, are summed. ``rows`` is counted where not given; it only sets the number of buckets.
    """
    rows = df.count() if rows is None else rows
    digits = math.ceil(math.log(rows / per_bucket, 16)) if rows > per_bucket else 0
    df = df.withColumn("_order", order)
    df = df.withColumn("_bucket", F.substring("_order", 1, digits) if digits else F.lit(""))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_order")
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("group_rows", F.sum("_n").over(Window.partitionBy(*groups)))
    keys = [*groups, "_bucket"]
    counts = counts.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], "_before", "group_rows")
    same = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
    out = df.withColumn("_inside", F.row_number().over(inside)).join(counts, same)
    out = out.withColumn("rank", F.col("_before") + F.col("_inside"))
    return out.drop("_order", "_bucket", "_inside", "_before", *[f"_c{i}" for i in range(len(keys))])
