"""Decisions for batches of requests: duplicate or not, with candidates; clusters of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.text import clamp
from lapwing.operators.blocks import top_k
from lapwing.operators.bounded import nearest
from lapwing.operators.calibrate import lookup


def candidates(requests: DataFrame, items: DataFrame, k: int, drop_self: bool = True, earlier: bool = False, same: bool = False, floor: float = float("-inf")) -> DataFrame:
    """Ranked candidates of ``requests`` (query_id, vec) with sku_id and similarity clamped to 0..1; with ``earlier``, of a smaller ``turn``
    than the request's; with ``same``, the requests are the items. Items under ``floor`` may be left out."""
    found = top_k(requests, items, k, drop_self, earlier=True) if earlier else nearest(requests, items, k, drop_self, same=same, floor=floor)
    return found.join(items.select("item_id", "sku_id"), "item_id").withColumn("similarity", clamp(F.col("similarity")))


def check(requests: DataFrame, items: DataFrame, thresholds: DataFrame, k: int = 5, drop_self: bool = True, earlier: bool = False, same: bool = False) -> DataFrame:
    """A row per request (query_id, category, vec): query_id, is_duplicate, threshold_used, best similarity (0 without candidates)
    and ``candidates`` in rank order. The best candidate decides, against its request's category."""
    found = candidates(requests, items, k, drop_self, earlier, same)
    entry = F.struct("rank", "sku_id", F.round("similarity", 6).alias("similarity"))
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates"), F.max("similarity").alias("best"))
    out = lookup(requests.select("query_id", "category"), thresholds).join(lists, "query_id", "left")
    best = F.coalesce("best", F.lit(0.0))
    return out.select(
        "query_id", (best >= F.col("threshold_used")).alias("is_duplicate"), "threshold_used", best.alias("similarity"),
        F.coalesce(F.transform("candidates", lambda c: c.dropFields("rank")), F.array().cast("array<struct<sku_id:bigint,similarity:double>>")).alias("candidates"),
    )


def check_any(requests: DataFrame, items: DataFrame, threshold: float = 0.86, k: int = 5, earlier: bool = False, same: bool = False) -> DataFrame:
    """The single-threshold mode: (query_id, is_duplicate, similarity, n_hits), with every hit at the threshold or more."""
    floor = threshold - 1e-9 if threshold > 0 else float("-inf")  # similarities are clamped to 0 or more
    found = candidates(requests, items, k, earlier=earlier, same=same, floor=floor).filter(F.col("similarity") >= threshold)
    hits = found.groupBy("query_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_hits"))
    out = requests.select("query_id").join(hits, "query_id", "left")
    return out.select("query_id", F.col("n_hits").isNotNull().alias("is_duplicate"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def named(found: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates (item_id, ...) with the ``name`` of their item in ``names`` (item_id, name), ``SKU_`` and the id where there is none."""
    known = names.select(F.col("item_id").alias("_item"), "name")
    out = found.join(known, F.col("item_id") == F.col("_item"), "left").drop("_item")
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit("SKU_"), F.col("item_id").cast("string"))))


def tagged(found: DataFrame, threshold: float) -> DataFrame:
    """Candidates with ``distance`` and ``is_match``."""
    return found.withColumns({"distance": 1 - F.col("similarity"), "is_match": F.col("similarity") >= threshold})


def by_sku(found: DataFrame) -> DataFrame:
    """(query_id, rank, sku_id, similarity): each SKU once, by its best item."""
    best = found.groupBy("query_id", "sku_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "sku_id")
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "sku_id", "similarity")


def validated(requests: DataFrame, most_k: int = 50) -> DataFrame:
    """``requests`` (…, image_base64, top_k) with ``error``: what is wrong with a request, null if nothing."""
    image = F.coalesce(F.col("image_base64"), F.lit("")) == ""
    return requests.withColumn("error", F.when(image, "image_base64 is required").when(~F.coalesce(F.col("top_k").between(1, most_k), F.lit(False)), f"top_k must be 1 to {most_k}"))
