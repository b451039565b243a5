"""Arrivals as streams: a bounded bank of the latest vectors, and check-before-insert into a growing index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lapwing.operators.serve import check, check_any


def ring_bank(arrivals: DataFrame, size: int) -> DataFrame:
    """The state of a ring of the last ``size`` arrivals (bank, seq, item_id) of each bank, after each micro-batch:
    (bank, seq, item_id). State is bounded by ``size``; arrival order is ``seq``, whatever order a batch holds."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"seq": list(state.get[0]), "item_id": list(state.get[1])}) if state.exists else pd.DataFrame({"seq": [], "item_id": []})
        for pdf in batches:  # cut after each Arrow batch, so a large micro-batch is never held whole
            held = pd.concat([held, pdf[["seq", "item_id"]]]).sort_values("seq").tail(size)
        held = held.astype("int64")
        state.update((held["seq"].tolist(), held["item_id"].tolist()))
        yield held.assign(bank=key[0])[["bank", "seq", "item_id"]]

    return arrivals.groupBy("bank").applyInPandasWithState(
        update, "bank string, seq long, item_id long", "seqs array<long>, items array<long>", "update", GroupStateTimeout.NoTimeout)


def check_then_insert(arrivals: DataFrame, index_path: str, out_path: str, checkpoint: str, thresholds: DataFrame | None = None, threshold: float = 0.86, k: int = 5) -> StreamingQuery:
    """For each micro-batch of arrivals (item_id, sku_id, category, vec): decide against the index as it stood before the
    batch and against those of the batch with a smaller item_id, as if they came one by one; write the decisions, then append the
    batch to the index. The index folder must hold a table.

    A batch writes folders of its own number, so a batch that runs again after a failure replaces what it wrote.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("item_id", "sku_id", "category", "vec").persist()
        known = spark.read.schema("item_id long, sku_id long, category string, vec array<double>, batch long").parquet(index_path).filter(F.col("batch") < number)
        requests = batch.select(F.col("item_id").alias("query_id"), "category", "vec", F.col("item_id").alias("turn"))
        first = F.lit(-(2**63)).alias("turn")
        known = known.select("item_id", "sku_id", "vec", first).unionByName(batch.select("item_id", "sku_id", "vec", F.col("item_id").alias("turn")))
        if thresholds is None:
            decided = check_any(requests, known, threshold, k, earlier=True)
        else:
            decided = check(requests, known, thresholds, k, earlier=True).select("query_id", "is_duplicate", "similarity")
        decided.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{index_path}/batch={number}")
        batch.unpersist()

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
