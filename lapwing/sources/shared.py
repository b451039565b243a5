"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it names nothing, a private folder if all of Spark runs in this process (tests, trials);
    on a cluster other machines would not see it, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lapwing-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def once(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder, for plans that read it several times; a lost executor costs a reread."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_STORED: list[tuple[SparkSession, str]] = []
_WITHIN: ContextVar[list[str] | None] = ContextVar("within", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores within go at its end, where all that reads them is done."""
    paths: list[str] = []
    token = _WITHIN.set(paths)
    try:
        yield
    finally:
        _WITHIN.reset(token)
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str, **options: object) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for plans that read it several times or would outgrow their lineage. The table goes when the session ends.
    ``options`` are those of the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lapwing-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if not _STORED:
        atexit.register(_drop_stored)
    _STORED.append((spark, path))
    if (within := _WITHIN.get()) is not None:
        within.append(path)
    return spark.read.schema(df.schema).parquet(path)


def least_hashes(rows: DataFrame, key: str, most: int, *then: str) -> DataFrame:
    """The ``most`` rows of least hash of ``key`` (then of least key, and ``then``), for samples that the driver collects. An ordered limit alone sends it so many rows
    of every partition: rows that cannot be among them go first, by the hash that their number suggests, and one task ranks the few that are left."""
    n, hashed = rows.count(), F.xxhash64(key)
    if n > 2 * most:
        few = rows.filter(hashed < F.lit(int(-(2**63) + (most + 8 * most**0.5 + 64) / n * 2**64)))
        rows = few if few.count() >= most else rows
    return rows.repartition(1).orderBy(hashed, key, *then).limit(most)


def _drop_stored() -> None:
    for spark, path in _STORED:
        try:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session is over: whoever owns the folder clears it
            return
