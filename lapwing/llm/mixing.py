"""Weighted fair queueing of sources into one training mix.

Each source is shuffled by the md5 of its documents' ids and served like a flow of a fair
queue: a copy of a document ends at virtual time (words of its source served so far) divided
by the source's target. Copies sorted by that time, cut where their words reach the budget,
are the mix. Epochs follow one another: copy ``c`` of a source of ``S`` words starts at
``c * S`` words, so one prefix sum per source places every copy.

Prefix sums never put a source into one task. Documents fall into buckets by the first digits
of their md5, and buckets into groups by half of these digits: windows run over a source's groups, over a group's buckets, and inside
each bucket. The cut is found the same way, over slices of virtual time and groups of slices; only the slice that
holds the cut is sorted exactly. Buckets and slices grow with the number of documents and groups with its square root, so
a bucket or slice stays near ``rows_per_bucket`` rows and no window has more rows than a group or a level of groups, whatever
the size of the largest source.

Defined results for odd input: a null text counts 0 words, a null source is a source of its own
that comes last, documents of 0 words are never taken, repeated rows count each by itself
(ties in md5 and id are ordered by size; equal rows are interchangeable), an empty table gives
an empty mix. Columns of the input other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """``target`` of each row of ``totals`` (source, source_size): shares of the whole by weight, none over
    ``repeats`` times its source's size, what is cut off shared again by weight among the others.

    Sorted by cap per weight, the capped sources come first, so one pass of running sums finds the
    level at which the others share what is left. The table has a row per source.
    """
    by_name, by_ratio, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place"), Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    choice = F.array(*[F.lit(int(w)) for w in weights])
    out = totals.withColumn("place", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.get(choice, F.col("place") % len(weights)).cast("long"))
    out = out.withColumn("cap", repeats * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("whole", F.sum("source_size").over(everything))
    level = (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    out = out.withColumn("capped", F.col("ratio") < level)
    left = F.col("whole") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = left / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share * F.col("weight"))
    return out.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), "whole")


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3, rows_per_bucket: int = 2000,
) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, ``finish`` (virtual
    time of the first copy; null if never served), ``copies`` that the mix takes and ``taken`` words."""
    return _mixed(docs, weights, repeats, rows_per_bucket).drop("text_key")


def _mixed(docs: DataFrame, weights: Sequence[int], repeats: int, rows_per_bucket: int = 2000) -> DataFrame:
    """``mix`` with ``text_key``, a hash of the row's text."""
    sized = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("key"),
    )
    sized = table(sized, "sizes")
    rows = max(1, sized.count())
    digits = max(0, math.ceil(math.log(rows / rows_per_bucket, 16))) if rows > rows_per_bucket else 0
    slices = max(16, rows // rows_per_bucket)
    sized = sized.withColumn("bucket", F.substring("key", 1, digits) if digits else F.lit(""))

    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, repeats)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = table(buckets.withColumn("group", F.substring("bucket", 1, digits // 2) if digits // 2 else F.lit("")), "buckets")
    along = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = buckets.groupBy("source", "group").agg(F.sum("bucket_size").alias("group_size"))
    groups = groups.select(
        F.col("source").alias("source_"), F.col("group").alias("group_"), F.coalesce(F.sum("group_size").over(along), F.lit(0)).alias("group_start"))
    along = Window.partitionBy("source", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("in_group", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)))
    buckets = buckets.join(groups, (F.col("group") == F.col("group_")) & F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "group_")
    buckets = buckets.withColumn("bucket_start", F.col("group_start") + F.col("in_group"))
    buckets = buckets.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    b = buckets.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), "bucket_start", "source_size", "target", "whole")

    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    served = sized.withColumn("inside", F.sum("size").over(inside))
    served = served.join(b, (F.col("bucket") == F.col("bucket_")) & F.col("source").eqNullSafe(F.col("source_")))
    end = F.col("bucket_start") + F.col("inside")
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)), lambda c: (c * F.col("source_size") + end).cast("double") / F.col("target")
    )
    served = served.withColumn("ends", F.when((F.col("target") > 0) & (F.col("size") > 0), ends))
    served = table(served.select("doc_id", "source", "text_key", "size", "source_size", "target", "whole", "key", "ends"), "served")

    slice_of = lambda end: F.least(F.floor(end * slices), F.lit(8 * slices))
    copies = served.select("doc_id", "source", "size", "whole", "key", F.explode("ends").alias("end")).withColumn("slice", slice_of(F.col("end")))
    width = max(1, math.isqrt(8 * slices))
    cut = table(copies.groupBy("slice").agg(F.sum("size").alias("words"), F.max("whole").alias("whole")), "slices")
    cut = cut.withColumn("group", F.floor(F.col("slice") / width))
    passes = lambda df: df.filter((F.col("before") + F.col("words") > F.col("whole")) & (F.col("before") <= F.col("whole")))
    upto = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = cut.groupBy("group").agg(F.sum("words").alias("words"), F.max("whole").alias("whole")).withColumn("before", upto(Window.orderBy("group")))
    group = passes(group).select(F.col("group").alias("cut_group"), F.col("before").alias("group_before"))
    cut = cut.join(F.broadcast(group), F.col("group") == F.col("cut_group"))
    cut = passes(cut.withColumn("before", F.col("group_before") + upto(Window.partitionBy("cut_group").orderBy("slice"))))
    # One row at most: the slice in which the words pass the budget; no row where every copy fits.
    cut = cut.select(F.col("slice").alias("cut_slice"), "before")
    edge = copies.join(F.broadcast(cut), F.col("slice") == F.col("cut_slice"))
    upto = Window.partitionBy("cut_slice").orderBy("end", F.col("source").asc_nulls_last(), "key", "doc_id", "size")
    edge = edge.withColumn("total", F.col("before") + F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    last = edge.filter(F.col("total") <= F.col("whole"))
    point = lambda end: F.struct(
        end.alias("end"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), "key",
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size",
    )
    # The last copy that fits, as a point in the order of the mix; or the start of the slice, where none in it fits.
    bound = cut.agg(F.max("cut_slice").alias("cut_slice")).crossJoin(last.agg(F.max(point(F.col("end"))).alias("last")))
    out = served.crossJoin(F.broadcast(bound))
    taken = lambda end: (
        F.col("cut_slice").isNull() | (slice_of(end) < F.col("cut_slice")) | ((slice_of(end) == F.col("cut_slice")) & F.coalesce(point(end) <= F.col("last"), F.lit(False)))
    )
    n = F.coalesce(F.size(F.filter("ends", taken)), F.lit(0)).cast("long")
    n = F.when(F.col("ends").isNull(), F.lit(0).cast("long")).otherwise(n)
    return out.select(
        "doc_id", "source", "text_key", "size", "source_size", "target", F.get("ends", F.lit(0)).alias("finish"),
        n.alias("copies"), (n * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, sorted by virtual finish time over
    range partitions, with the columns of ``docs``. Rows that share a doc_id are told apart by source and text; of equal rows, each has
    the copies of one of them."""
    last = 2**63 - 1
    same = ("_id", "_source", "_key")
    mixed = _mixed(docs, weights, repeats).filter("copies > 0").groupBy(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("_id"), F.col("source").alias("_s"), F.col("text_key").alias("_k"),
    ).agg(F.reverse(F.array_sort(F.collect_list(F.struct("copies", -F.col("finish"))))).alias("each"), F.max(F.col("source_size") / F.col("target")).alias("lap"))
    names = [f"_c{i}" for i in range(len(docs.columns))]  # the columns of ``docs`` may have any names
    rows = docs.select(
        *[docs[c].alias(n) for c, n in zip(docs.columns, names)], F.coalesce(docs["doc_id"].cast("long"), F.lit(last)).alias("_id"),
        docs["source"].alias("_source"), F.xxhash64(docs["text"]).alias("_key"))
    out = rows.join(mixed, "_id").filter(F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")))
    # Texts are moved twice in all: the window finds them as the join has dealt them.
    out = out.withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))).withColumn("_one", F.get("each", F.col("_nth") - 1))
    out = out.filter("_one is not null").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_one")["copies"] - 1)))
    out = out.withColumn("_end", F.col("_copy") * F.col("lap") - F.col("_one")["col2"])
    return out.repartitionByRange("_end").sortWithinPartitions("_end", "_id").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


#: DuckDB form of ``mix`` with its defaults over ``documents``: plain windows over whole sources.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS whole FROM w),
l AS (
  SELECT *, CAST(whole - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
t AS (
  SELECT *, CASE WHEN ratio < level THEN CAST(cap AS DOUBLE) ELSE
      CAST(whole - coalesce(sum(cap) FILTER (ratio < level) OVER (), 0) AS DOUBLE)
      / CAST(sum(weight) FILTER (NOT ratio < level) OVER () AS DOUBLE) * weight END AS target FROM l),
c AS (
  SELECT d.*, t.source_size, coalesce(t.target, 0.0) AS target, t.whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT c.*, copy, CAST(copy * source_size + upto AS DOUBLE) / target AS ends
  FROM c, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0),
o AS (
  SELECT *, sum(size) OVER (ORDER BY ends, source NULLS LAST, key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS total FROM e),
n AS (SELECT doc_id, source, key, min(ends) AS finish, count(*) FILTER (total <= whole) AS copies FROM o GROUP BY doc_id, source, key)
SELECT c.doc_id, c.source, c.size, c.source_size, c.target, n.finish, CAST(coalesce(n.copies, 0) AS BIGINT) AS copies,
       CAST(coalesce(n.copies, 0) * c.size AS BIGINT) AS taken
FROM c LEFT JOIN n ON c.doc_id IS NOT DISTINCT FROM n.doc_id AND c.source IS NOT DISTINCT FROM n.source AND c.key = n.key
"""
