"""Bucketed, sorted tables: rows of one key lie together, so grouping and joining by it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lapwing.sources.shared import shared_folder


def bucketed(df: DataFrame, key: str, buckets: int | None = None, label: str = "bucketed") -> DataFrame:
    """``df`` as a table in the shared folder, dealt to ``buckets`` (shuffle partitions, where not given) by ``key`` and sorted by it in each. Tables of
    equal bucket counts join by the key in place. The rows are dealt before they are written, so a bucket is one file."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lapwing_{label}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
