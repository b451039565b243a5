"""Endless training triplets: a streaming source of draws, epoch after epoch, joined with the triplets in each epoch's order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lapwing.operators.pairs import shuffled

DRAWS = "draw long, epoch long, place long"


class Stretch(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class DrawReader(DataSourceStreamReader):
    """Draws ``start``, ``start + 1``, ... of ``rows`` places an epoch, ``batch`` of them a micro-batch, up to ``until`` where that is given. The
    offset is the next draw."""

    def __init__(self, options: dict[str, str]):
        self.rows, self.batch = int(options["rows"]), int(options.get("batch", 10_000))
        self.start, self.until = int(options.get("start", 0)), int(options.get("until", 2**62))
        self.reached = None

    def initialOffset(self) -> dict:
        return {"draw": self.start}

    def latestOffset(self) -> dict:
        self.reached = min(self.until, (self.start if self.reached is None else self.reached) + self.batch)
        return {"draw": self.reached}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.reached = max(self.reached or 0, end["draw"])  # after a restart the offsets come from the checkpoint
        cuts = range(start["draw"], end["draw"], 100_000)
        return [Stretch(a, min(a + 100_000, end["draw"])) for a in cuts]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        draw = np.arange(part.start, part.stop, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(draw // self.rows), pa.array(draw % self.rows + 1)], ["draw", "epoch", "place"])

    def commit(self, end: dict) -> None:
        """Nothing is kept for a draw."""


class Draws(DataSource):
    @classmethod
    def name(cls) -> str:
        return "draws"

    def schema(self) -> str:
        return DRAWS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return DrawReader(self.options)


def draws(spark: SparkSession, rows: int, batch: int, start: int = 0, until: int | None = None) -> DataFrame:
    """A stream of (draw, epoch, place)."""
    spark.dataSource.register(Draws)
    reader = spark.readStream.format("draws").option("rows", rows).option("batch", batch).option("start", start)
    return (reader if until is None else reader.option("until", until)).load()


def serve_triplets(stream: DataFrame, triplets: DataFrame, out_path: str, checkpoint: str, seed: int = 42) -> StreamingQuery:
    """Writes, for each micro-batch of ``stream``, its draws with the columns of ``triplets`` (sku_id, ...): the triplet that stands at the draw's place in
    its epoch's shuffled order. A batch's epochs are few: it holds a bounded number of draws. A batch that runs again replaces what it wrote."""

    def handle(batch: DataFrame, number: int) -> None:
        epochs = [r[0] for r in batch.select("epoch").distinct().orderBy("epoch").collect()]
        orders = [shuffled(triplets, "sku_id", e, seed).withColumns({"_epoch": F.lit(e)}).withColumnRenamed("place", "_place") for e in epochs]
        if not orders:
            return
        every = orders[0]
        for order in orders[1:]:
            every = every.unionByName(order)
        rows = batch.join(every, (F.col("epoch") == F.col("_epoch")) & (F.col("place") == F.col("_place"))).drop("_epoch", "_place")
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
