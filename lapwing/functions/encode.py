"""Texts to vectors by signed feature hashing, in plain expressions: the encode step where no trained tower is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.vectors import normalise


def encode_texts(rows: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """(key, vec): unit vectors of ``dim`` components. A word (blank-separated, in lower case) adds 1 to the component that its md5 names or takes 1 from it, as another
    digit says; null, empty and blank texts are zero vectors. Rows with one key, a null key among them, are one text together.
    Words are counted before the shuffle, ``dim`` sums a key at most."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    word = rows.select(F.col(key).alias("k"), F.explode_outer(words).alias("w")).withColumn("h", F.md5("w"))
    component = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.substring("h", 9, 1) < "8", 1).otherwise(-1)
    sums = word.select("k", component.alias("i"), F.when(F.col("w").isNotNull(), sign).alias("s")).groupBy("k", "i").agg(F.sum("s").alias("s"))
    held = sums.groupBy("k").agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "s")))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return held.select(F.col("k").alias(key), vec.alias("v")).select(key, normalise(F.col("v")).alias("vec"))
