"""Readers and writers of catalog files, all through Spark's own sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "sku_id string, image_path string, image_index int, is_main_image boolean, title string, brand string, category string, split string"


def _is_listing_shard(name: Column) -> Column:
    low = F.lower(name)
    return (low.endswith(".json") | low.endswith(".json.gz")) & ~(low.contains("images") & ~low.contains("listing"))


def _text(v: Column, path: str) -> Column:
    """A string value at ``path``, null for arrays and objects."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _entries(v: Column, path: str) -> Column:
    """A polymorphic text (string, list of tagged values, or one object) as a list of (language_tag, value)."""
    single = F.array(F.struct(F.lit(None).cast("string").alias("language_tag"), _text(v, path).alias("value")))
    one = F.array(F.struct(F.lit(None).cast("string").alias("language_tag"), F.try_variant_get(v, f"{path}.value", "string").alias("value")))
    many = F.try_variant_get(v, path, "array<struct<language_tag string, value string>>")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", single).when(kind.startswith("ARRAY"), many).when(kind.startswith("OBJECT"), one)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of the JSON-lines shards under ``path`` (plain or gzip), in no order. Blank and malformed lines are skipped; each line is
    a listing of its own, also where item ids repeat. A listing's id follows from its file, its line's text and how many equal lines of the file are counted
    before it, so it is the same however files are split among tasks, and listings can be ordered by (file, listing_id)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"))
    lines = lines.filter(_is_listing_shard(F.col("name")) & (F.trim("value") != ""))
    equal = Window.partitionBy("file", F.md5("value")).orderBy(F.lit(0))
    lines = lines.withColumn("copy", F.row_number().over(equal))
    v = F.try_parse_json("value")
    rows = lines.withColumn("v", v).filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    v = F.col("v")
    others = F.coalesce(F.try_variant_get(v, "$.other_image_id", "array<string>"), F.array(_text(v, "$.other_image_id")))
    return rows.select(
        F.md5(F.concat_ws("|", "file", "value", F.col("copy").cast("string"))).alias("listing_id"), F.try_variant_get(v, "$.item_id", "string").alias("item_id"),
        _entries(v, "$.item_name").alias("item_name"), _entries(v, "$.brand").alias("brand"),
        F.get(_entries(v, "$.product_type"), F.lit(0))["value"].alias("product_type"),
        F.try_variant_get(v, "$.main_image_id", "string").alias("main_image_id"), others.alias("other_image_ids"),
    )


def read_image_index(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """(image_id, path) of every ``images.csv`` (or .gz) under ``path``; rows without either are dropped."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "images.csv*").option("header", "true").csv(path)
    rows = rows.select("image_id", "path").filter("coalesce(image_id, '') <> '' and coalesce(path, '') <> ''")
    return rows.withColumn("path", F.concat_ws("/", F.lit(base.rstrip("/")), F.ltrim(F.col("path"), F.lit("/")))) if base else rows


def on_disk(manifest: DataFrame, path: str) -> DataFrame:
    """Rows whose image file exists under ``path``: a semi-join with a listing of names, contents unread."""
    files = manifest.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("there"))
    return manifest.join(files, F.regexp_replace("image_path", "^file:/+", "/") == F.col("there"), "left_semi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of CSV files; missing titles are empty texts."""
    return spark.read.schema(MANIFEST).option("header", "true").csv(path).fillna("", ["title", "brand"])


def write_manifest(manifest: DataFrame, path: str, form: str = "parquet") -> None:
    """By split, so that readers of one split skip the others."""
    writer = manifest.write.mode("overwrite").partitionBy("split")
    writer.option("header", "true").format(form).save(path)


def append_items(items: DataFrame, path: str) -> None:
    items.write.mode("append").parquet(path)


def write_parameters(spark: SparkSession, weights: dict, metadata: Sequence[tuple[str, str]], path: str) -> None:
    """A checkpoint: named arrays with shapes, and text metadata, as a table."""
    rows = [("weight", k, [int(n) for n in v.shape], [float(x) for x in v.ravel()], None) for k, v in weights.items()]
    rows += [("metadata", k, None, None, str(x)) for k, x in metadata]
    spark.createDataFrame(rows, "kind string, name string, shape array<int>, data array<double>, value string").write.mode("overwrite").parquet(path)


def read_parameters(spark: SparkSession, path: str) -> tuple[dict, dict]:
    import numpy as np

    rows = spark.read.parquet(path).collect()  # as large as one model
    return {r.name: np.array(r.data).reshape(r.shape) for r in rows if r.kind == "weight"}, {r.name: r.value for r in rows if r.kind == "metadata"}


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.select("category", "threshold").write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("category string, threshold double").json(path)


def event_log(events: DataFrame) -> DataFrame:
    """One JSON object per row, nulls left out."""
    return events.select(F.to_json(F.struct("*")).alias("value"))
