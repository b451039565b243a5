"""Training pairs by seeded ranks: positives of one SKU, negatives of its category, shuffles and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.hashing import token, uniform
from lapwing.operators.ranks import hash_rank


def positive_pairs(manifest: DataFrame, seed: int = 42) -> DataFrame:
    """(sku_id, anchor_path, positive_path, is_multi_angle): two different rows of each SKU, or its one row twice."""
    order = Window.partitionBy("sku_id").orderBy(token(seed, F.col("sku_id"), F.col("image_path")), "image_path")
    two = manifest.withColumn("n", F.row_number().over(order)).filter("n <= 2")
    out = two.groupBy("sku_id").agg(F.max(F.when(F.col("n") == 1, F.col("image_path"))).alias("anchor_path"), F.max(F.when(F.col("n") == 2, F.col("image_path"))).alias("second"))
    return out.select("sku_id", "anchor_path", F.coalesce("second", "anchor_path").alias("positive_path"), F.col("second").isNotNull().alias("is_multi_angle"))


def hard_negatives(skus: DataFrame, seed: int = 42) -> DataFrame:
    """(sku_id, category, negative_sku, same_category): the next SKU of the category in a shuffled ring, or of all SKUs where
    the category has no other. Rings are joined on rank, so no category is sorted by one task."""
    skus = skus.select("sku_id", "category")
    rows = skus.count()
    order = token(seed, F.col("sku_id"))
    ring = hash_rank(skus, ["category"], order, rows=rows)
    following = ring.select(F.col("category").alias("c"), F.col("rank").alias("r"), F.col("sku_id").alias("negative_sku"))
    near = ring.filter("group_rows > 1").withColumn("next", F.col("rank") % F.col("group_rows") + 1)
    near = near.join(following, F.col("category").eqNullSafe(F.col("c")) & (F.col("next") == F.col("r"))).select("sku_id", "category", "negative_sku", F.lit(True).alias("same_category"))
    every = hash_rank(skus, [], order, rows=rows)
    other = every.select(F.col("rank").alias("r"), F.col("sku_id").alias("negative_sku"))
    alone = ring.filter("group_rows = 1").select(F.col("sku_id").alias("lone"))
    far = every.join(alone, F.col("sku_id") == F.col("lone"), "left_semi").withColumn("next", F.col("rank") % F.col("group_rows") + 1)
    far = far.join(other, F.col("next") == F.col("r")).filter("sku_id <> negative_sku")
    return near.unionByName(far.select("sku_id", "category", "negative_sku", F.lit(False).alias("same_category")))


def triplets(manifest: DataFrame, seed: int = 42) -> DataFrame:
    """Positive pairs beside a row of a negative SKU; an error for an empty manifest."""
    if manifest.isEmpty():
        raise ValueError("no rows to draw triplets from")
    pairs = positive_pairs(manifest, seed)
    skus = manifest.groupBy("sku_id").agg(F.min("category").alias("category"))
    negative = pairs.select(F.col("sku_id").alias("negative_sku"), F.col("anchor_path").alias("negative_path"))
    return pairs.join(hard_negatives(skus, seed), "sku_id").join(negative, "negative_sku").select(
        "sku_id", "anchor_path", "positive_path", "negative_sku", "negative_path", "is_multi_angle", "same_category")


def draw_batch(pairs: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of ``pairs`` (sku_id, ...), with replacement: (draw, and the columns of ``pairs``). Empty: no rows."""
    ranked = hash_rank(pairs, [], token(seed, F.col("sku_id")))
    total = F.broadcast(pairs.agg(F.count("*").alias("total")).filter("total > 0"))
    draws = pairs.sparkSession.range(size).withColumnRenamed("id", "draw").crossJoin(total)
    draws = draws.withColumn("want", F.least(F.floor(uniform(f"{seed}:draw", F.col("draw")) * F.col("total")), F.col("total") - 1) + 1).drop("total")
    return draws.join(ranked, F.col("want") == F.col("rank")).drop("want", "rank", "group_rows")


def shuffled(df: DataFrame, key: str, epoch: int, seed: int = 42) -> DataFrame:
    """``df`` with ``place`` (from 1), its order in the epoch."""
    return hash_rank(df, [], token(f"{seed}:{epoch}", F.col(key))).withColumnRenamed("rank", "place").drop("group_rows")
