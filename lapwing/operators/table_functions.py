"""Search as a table function, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators.blocks import PAIRED, Best, PairedBest, _best, floored, merged, met, met_once, packed


class BlockTopK:
    """``block_topk(query_ids, queries, ids, vecs, k)``, for lateral joins: each row is a block of queries and one of items, ids and vectors packed. Gives the ``k`` items
    of largest product for each query of the block (query_id, item_id, similarity). A query's own id is no match."""

    def eval(self, query_ids: bytes, queries: bytes, ids: bytes, vecs: bytes, k: int) -> Iterator[tuple]:
        a, b = np.frombuffer(query_ids, np.int64), np.frombuffer(ids, np.int64)
        q, v = (np.frombuffer(x, np.float64).reshape(len(i), -1) for x, i in ((queries, a), (vecs, b)))
        best = _best(a, q, b, v, k, True, digits=12)
        yield from zip(best["query_id"].tolist(), best["item_id"].tolist(), np.round(best["similarity"], 12).tolist())


class Nearest:
    """``nearest(TABLE(rows) PARTITION BY ...)`` of rows (is_query, id, vec packed, k): the ``k`` items of largest product for each query of the partition, in Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.rows.append(rows)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.rows:
            rows = pa.Table.from_batches(self.rows)
            query = rows.column("is_query").to_numpy()
            ids, k = rows.column("id").to_numpy(), rows.column("k")[0].as_py()
            v = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
            items, own = np.flatnonzero(~query), np.flatnonzero(query)
            if len(items) and len(own):
                yield _table(_best(ids[own], v[own], ids[items], v[items], k, True, digits=12))


class NearestBlocks:
    """``nearest_blocks(TABLE(pairs))`` of ``block_pairs``, in Arrow batches: the ``k`` items of largest product for each query, found in a partition of the pairs. It
    holds one block of queries, which comes with the first of the items it meets."""

    def __init__(self) -> None:
        self.best: Best | None = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        packed = lambda name, i, kind: np.frombuffer(rows.column(name)[i].as_buffer(), kind)
        for i in range(rows.num_rows):
            if rows.column("a_ids")[i].is_valid:
                yield from self.terminate()
                ids = packed("a_ids", i, np.int64).copy()
                self.best = Best(ids, packed("a_vecs", i, np.float64).reshape(len(ids), -1).copy(), rows.column("k")[i].as_py(), True, 12)
            ids = packed("b_ids", i, np.int64)
            self.best.meet(ids, packed("b_vecs", i, np.float64).reshape(len(ids), -1))

    def terminate(self) -> Iterator[pa.Table]:
        if self.best is not None:
            yield _table(self.best.found())
            self.best = None


class PairedBlocks:
    """``paired_blocks(TABLE(pairs))`` of ``block_pairs_once``, in Arrow batches: for each block, packed, the ``k`` items of largest product that its items found in a partition
    of the pairs."""

    def __init__(self) -> None:
        self.found: PairedBest | None = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.num_rows:
            self.found = self.found or PairedBest(rows.column("k")[0].as_py(), True, 12)
            self.found.add(rows)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.found is not None:
            for batch in self.found.packed():
                yield pa.Table.from_batches([batch.append_column("k", pa.array([self.found.k], pa.int32()))])


class RankedBlocks:
    """``ranked_blocks(TABLE(found) PARTITION BY block)`` of what ``paired_blocks`` gives, in Arrow batches: the ``k`` items of largest product for each query, ranked."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.rows.append(rows)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.rows:
            rows = pa.Table.from_batches(self.rows).to_pandas()
            best = merged(rows, int(rows["k"].iloc[0]), 12)
            yield _table(best).add_column(1, "rank", pa.array(best["rank"], pa.int64()))


def _table(best: pd.DataFrame) -> pa.Table:
    return pa.table({"query_id": pa.array(best["query_id"], pa.int64()), "item_id": pa.array(best["item_id"], pa.int64()), "similarity": pa.array(np.round(best["similarity"], 12), pa.float64())})


FOUND = "query_id long, item_id long, similarity double"
RANKED = "query_id long, rank long, item_id long, similarity double"


def register(spark: SparkSession) -> None:
    """Makes ``nearest``, ``nearest_blocks``, ``paired_blocks``, ``ranked_blocks`` and ``block_topk`` known to SQL."""
    spark.udtf.register("paired_blocks", F.arrow_udtf(PairedBlocks, returnType=PAIRED + ", k int"))
    spark.udtf.register("ranked_blocks", F.arrow_udtf(RankedBlocks, returnType=RANKED))
    spark.udtf.register("nearest_blocks", F.arrow_udtf(NearestBlocks, returnType=FOUND))
    spark.udtf.register("nearest", F.arrow_udtf(Nearest, returnType=FOUND))
    spark.udtf.register("block_topk", F.udtf(BlockTopK, returnType=FOUND))  # lateral joins take no Arrow table function


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(id, vec) of rows (key, vec), vectors packed."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(vec=[np.asarray(v, np.float64).tobytes() for v in pdf["vec"]])

    return rows.filter("vec is not null").select(F.col(key).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInPandas(pack, "id long, vec binary")


def dealt_rows(queries: DataFrame, items: DataFrame, k: int, blocks: int) -> DataFrame:
    """(block, is_query, id, vec, k): items (item_id, vec) dealt to ``blocks``, and queries (query_id, vec) in each of them."""
    rows = _packed(items, "item_id").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("is_query"), "id", "vec")
    asks = _packed(queries, "query_id").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("is_query"), "id", "vec")
    return rows.unionByName(asks).withColumn("k", F.lit(k))


def block_pairs(queries: DataFrame | None, items: DataFrame, k: int, n_rows: int) -> DataFrame:
    """(block, a_ids, a_vecs, b_ids, b_vecs, k): blocks of queries (query_id, vec), or of the items themselves, each with the blocks of items (item_id, vec), packed."""
    held = packed(items, "item_id", n_rows=n_rows)
    return met(held if queries is None else packed(queries, "query_id", n_rows=n_rows), held).withColumn("k", F.lit(k))


def block_pairs_once(items: DataFrame, k: int, n_rows: int) -> DataFrame:
    """``met_once`` of blocks of items (item_id, vec), whose ids are all different, with ``k``."""
    return met_once(floored(items, k, True, 12, n_rows), ["floors"], n_rows).withColumn("k", F.lit(k))


def packed_blocks(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, ids, vecs): rows (key, vec) dealt to ``blocks``, each a row with its ids and vectors packed."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vecs": [b"".join(pdf["vec"])]})

    dealt = _packed(rows, key).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(pack, "block long, ids binary, vecs binary")
