"""Helpers shared by the corpus operators: shared-folder tables, word splitting, hashing.

Nothing here holds corpus-sized state on the driver. Intermediate tables go to
the folder that ``spark.checkpoint.dir`` names, so losing an executor costs a
recomputation of lost tasks only, never a lost table.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.sources.shared import shared_folder

U64 = np.uint64
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, also set as Spark's own for checkpoints."""
    named = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it cuts lineage and
    stops a costly plan from running once per consumer. Removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lapwing-{label}-{uuid.uuid4().hex}"
    clear(spark)
    df.write.parquet(path)
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    clear(spark)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that have become tables: it acts when the driver collects its garbage.
    What a write has just let go of may still be in a listener's queue, so the next table clears it again."""
    spark.sparkContext._jvm.System.gc()


def made() -> int:
    """A mark in the order of tables made."""
    return len(_MADE)


def discard(first: int, last: int) -> None:
    """Deletes the tables made from mark ``first`` up to mark ``last``: those that went into a table that has been written since, and are read no more."""
    for spark, path in _MADE[first:last]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # the JVM is gone already: the folder's owner expires it
            return


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi_join(df: DataFrame, keys: DataFrame, on: str, few: int = 500_000, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys`` (one column of numbers), or with ``left_anti`` the others. Up to ``few``
    keys, a dozen megabytes, go to every task; more are joined by a shuffle."""
    small = keys.count() <= few
    return df.join(F.broadcast(keys) if small else keys, on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply): spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
