"""Catalog building: listings to manifest, filters, consolidation, samples, splits, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.hashing import token
from lapwing.functions.text import or_other, pick_localised
from lapwing.operators.order import order_statistics
from lapwing.operators.ranks import hash_rank
from lapwing.sources.shared import stored


def image_ids(main: Column, others: Column) -> Column:
    """Main image first, then the others, without repeats or empty ids."""
    both = F.concat(F.array(main), F.coalesce(others, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))


def build_manifest(listings: DataFrame, images: DataFrame) -> DataFrame:
    """A row per image of a listing (listing_id, item_id, item_name, brand, product_type, main_image_id, other_image_ids)
    that the index (image_id, path) knows; positions count surviving images, so the first survivor is the main one.
    Listings without item_id or without any known image have no rows."""
    flat = listings.filter(F.coalesce("item_id", F.lit("")) != "").select(
        "listing_id", F.col("item_id").alias("sku_id"), pick_localised(F.col("item_name")).alias("title"), pick_localised(F.col("brand")).alias("brand"),
        or_other(F.col("product_type")).alias("category"), F.posexplode(image_ids(F.col("main_image_id"), F.col("other_image_ids"))).alias("place", "image_id"),
    )
    known = flat.join(images.filter("image_id is not null and path is not null"), "image_id")
    place = F.row_number().over(Window.partitionBy("listing_id").orderBy("place")) - 1
    return known.select("sku_id", F.col("path").alias("image_path"), place.alias("image_index"), (place == 0).alias("is_main_image"), "title", "brand", "category")


def with_min_images(manifest: DataFrame, least: int) -> DataFrame:
    """Rows of SKUs that have ``least`` rows or more."""
    return manifest.join(manifest.groupBy("sku_id").count().filter(F.col("count") >= least).select("sku_id"), "sku_id", "left_semi")


def consolidate(manifest: DataFrame, least_skus: int = 20, other: str = "OTHER") -> DataFrame:
    """Categories of fewer than ``least_skus`` SKUs become ``other``."""
    small = manifest.groupBy("category").agg(F.countDistinct("sku_id").alias("n")).filter(F.col("n") < least_skus)
    small = small.select(F.col("category").alias("small"))
    out = manifest.join(small, F.col("category").eqNullSafe(F.col("small")), "left")
    return out.withColumn("category", F.when(F.col("small").isNotNull(), other).otherwise(F.col("category"))).drop("small")


def sku_table(manifest: DataFrame) -> DataFrame:
    """(sku_id, category, n_rows): the least category of a SKU that has several."""
    return manifest.groupBy("sku_id").agg(F.min("category").alias("category"), F.count("*").alias("n_rows"))


def stratified_sample(skus: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` SKUs (all, if fewer), categories by largest remainder; without strata where one has a single SKU."""
    counts = skus.groupBy("category").agg(F.count("*").alias("n"))
    whole, least = counts.agg(F.sum("n"), F.min("n")).first()
    if whole is None or whole <= size:
        return skus
    stratified = least >= 2
    skus = skus.withColumn("stratum", F.col("category") if stratified else F.lit("*"))
    quotas = skus.groupBy("stratum").agg(F.count("*").alias("n"))
    share = F.col("n") * size
    quotas = quotas.withColumns({"base": F.floor(share / whole), "left": share % whole})
    extra = F.row_number().over(Window.orderBy(F.desc("left"), "stratum")) <= size - F.sum("base").over(Window.partitionBy())
    quotas = quotas.select("stratum", (F.col("base") + extra.cast("long")).alias("quota"))
    ranked = hash_rank(skus, ["stratum"], token(seed, F.col("sku_id")), rows=whole)
    return ranked.join(quotas, "stratum").filter(F.col("rank") <= F.col("quota")).drop("rank", "group_rows", "quota", "stratum")


def split_skus(skus: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``skus`` with ``split``: each category is cut at the same shares of its shuffled SKUs; without strata where one
    has a single SKU."""
    if abs(train + val + test - 1) > 1e-5:
        raise ValueError("split ratios must sum to 1")
    least = skus.groupBy("category").count().agg(F.min("count")).first()[0]
    skus = skus.withColumn("stratum", F.col("category") if least is not None and least >= 2 else F.lit("*"))
    ranked = hash_rank(skus, ["stratum"], token(seed, F.col("sku_id")))
    at = (F.col("rank") - 0.5) / F.col("group_rows")
    return ranked.withColumn("split", F.when(at < train, "train").when(at < train + val, "val").otherwise("test")).drop("rank", "group_rows", "stratum")


def assert_disjoint(split: DataFrame) -> DataFrame:
    """``split`` (sku_id, split), or an error at the first SKU that is in two splits."""
    n = F.countDistinct("split")
    mixed = split.groupBy("sku_id").agg(n.alias("n")).filter("n > 1")
    if not mixed.isEmpty():
        raise ValueError("SKUs are in several splits")
    return split


def leaks(split: DataFrame) -> DataFrame:
    """(a, b, shared): SKUs shared by each pair of splits."""
    pairs = split.select("sku_id", "split").distinct()
    each = pairs.groupBy("sku_id").agg(F.collect_set("split").alias("s"))
    rows = [(F.lit(a), F.lit(b)) for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
    flags = F.array(*[F.struct(a.alias("a"), b.alias("b"), (F.array_contains("s", a) & F.array_contains("s", b)).cast("long").alias("shared")) for a, b in rows])
    return each.select(F.explode(flags).alias("f")).groupBy("f.a", "f.b").agg(F.sum("f.shared").alias("shared"))


def category_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("category").agg(F.count("*").alias("n_rows"), F.countDistinct("sku_id").alias("n_skus"))


def last_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of each key's last row by ``order``, as a dictionary keeps what is put last."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def category_sketches(manifest: DataFrame, bits: int = 12) -> DataFrame:
    """(category, sketch): a sketch of fixed size of each category's distinct SKUs. Sketches of parts of a catalog are merged by ``hll_union_agg``, so SKUs are counted
    without moving them; the estimate is within 5 % or so."""
    return manifest.groupBy("category").agg(F.hll_sketch_agg("sku_id", bits).alias("sketch"))


def end_to_end_splits(listings: DataFrame, images: DataFrame, target: int, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Listings to a manifest, ``target`` SKUs of it by category, and their splits: manifest rows with ``split``."""
    manifest = stored(build_manifest(listings, images), "manifest")
    chosen = stratified_sample(stored(sku_table(manifest), "skus"), target)
    split = split_skus(stored(chosen, "chosen"), train, val, test)
    return manifest.join(split.select("sku_id", "split"), "sku_id")


def images_per_sku(manifest: DataFrame) -> DataFrame:
    """One row: mean, median, most and least rows of a SKU."""
    n = stored(manifest.groupBy("sku_id").agg(F.count("*").alias("n")), "sku-counts")
    skus = n.count()
    middle = order_statistics(n, "n", [(skus - 1) // 2, skus // 2]) if skus else []
    median = F.lit(sum(middle) / 2 if middle else None).cast("double").alias("median")
    return n.agg(F.count("*").alias("n_skus"), F.avg("n").alias("mean"), median, F.max("n").alias("most"), F.min("n").alias("least"))


def split_totals(manifest: DataFrame) -> DataFrame:
    """Rows and distinct SKUs of each split, and of all (split null): a rollup."""
    return manifest.rollup("split").agg(F.count("*").alias("n_rows"), F.countDistinct("sku_id").alias("n_skus"))


def catalog_stats(manifest: DataFrame) -> DataFrame:
    """One row of JSON: totals, rows by split and by category, images per SKU."""
    split = manifest.groupBy("split").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("splits"))
    cats = manifest.groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    return split.crossJoin(cats).crossJoin(images_per_sku(manifest)).select(F.to_json(F.struct("*")).alias("stats"))
