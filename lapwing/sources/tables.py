"""Catalog views of the benchmark tables: what the operators take as listings, items, titles and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.vectors import doubles, normalise


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested listings: a part with localised names, one image per supplier, the last one as the main image."""
    part, lineitem = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    images = lineitem.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("sellers"))
    entry = lambda tag, value: F.struct(F.lit(tag).alias("language_tag"), value.alias("value"))
    name, key = F.col("p_name"), F.col("p_partkey")
    names = F.when(key % 3 == 0, F.array(entry("de_DE", F.concat(F.lit("de "), name)), entry("en_US", name)))
    names = names.when(key % 3 == 1, F.array(entry("en_GB", F.concat(F.lit(" "), name)))).otherwise(F.array(entry("fr_FR", name), entry("es_ES", F.upper(name))))
    out = part.join(images, F.col("p_partkey") == F.col("l_partkey"))
    image = lambda s: F.concat_ws("-", F.col("p_partkey").cast("string"), s.cast("string"))
    return out.select(
        key.cast("string").alias("listing_id"), F.when(key % 97 != 0, key.cast("string")).alias("item_id"), names.alias("item_name"),
        F.array(entry("en_US", F.col("p_brand"))).alias("brand"), F.when(key % 50 == 0, "").otherwise(F.col("p_type")).alias("product_type"),
        image(F.element_at("sellers", -1)).alias("main_image_id"), F.transform("sellers", image).alias("other_image_ids"),
    )


def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, path) of the sellers' images; one seller in ten has none."""
    pairs = read(spark, sf_dir, "lineitem").filter("l_suppkey % 10 <> 3").select("l_partkey", "l_suppkey").distinct()
    image = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return pairs.select(image.alias("image_id"), F.concat(F.lit("img/"), image, F.lit(".jpg")).alias("path"))


def manifest(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """One row per (part, supplier) as (sku, image); ``fine`` categories are brand and size group."""
    part, lineitem = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct()
    category = F.concat_ws(":", "p_brand", (F.col("p_size") % 5).cast("string")) if fine else F.col("p_type")
    return pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("sku_id"), F.concat(F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"), F.lit(".jpg")).alias("image_path"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), category.alias("category"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings per vector: itself and a perturbed copy. (item_id, sku_id, category, vec), unit vectors."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("v"))
    amplitude = 0.2 + 0.1 * (F.col("vec_id") % 5)
    noise = lambda x, i: x + amplitude * (((F.col("vec_id") * 7919 + (i + 1) * 104729 + F.col("vec_id") * (i + 1) * 31) % 1009) / 1009.0 - 0.5)
    both = F.array(
        F.struct((2 * F.col("vec_id")).alias("item_id"), F.col("v").alias("vec")),
        F.struct((2 * F.col("vec_id") + 1).alias("item_id"), normalise(F.transform("v", noise)).alias("vec")),
    )
    return e.select(F.col("vec_id").alias("sku_id"), F.col("label").alias("category"), F.explode(both).alias("i")).select("i.item_id", "sku_id", "category", "i.vec")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sku_id, title, category, brand): documents as titles; the brand is the first word."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sku_id"), F.col("text").alias("title"), F.col("source").alias("category"), F.get(F.split("text", r"\s+"), F.lit(0)).alias("brand"))


def pixel_grid(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """(vec_id, pixels): a gray image of size x size, row by row."""
    cells = F.sequence(F.lit(0), F.lit(size * size - 1))
    row, column = (lambda p: F.floor(p / size)), (lambda p: p % size)
    value = lambda p: ((F.col("vec_id") * 37 + row(p) * row(p) * 11 + column(p) * column(p) * 7) % 256).cast("double")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(cells, value).alias("pixels"))
