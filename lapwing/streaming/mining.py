"""Stateful work on ordered arrivals that survives a restart: mining against a bank, and the best value so far."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Stateful processors keep their state in the store that can hold lists and values side by side."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


#: State partitions of a stream with few keys: each is a task of every micro-batch, and has a store of its own.
STATE_PARTITIONS = 16


@contextmanager
def few_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that start within have ``STATE_PARTITIONS`` at most; one that goes on from a checkpoint keeps those that it has."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), STATE_PARTITIONS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class BankMiner(StatefulProcessor):
    """Each arrival is held against the ``size`` arrivals before it in its bank, of other SKUs: the ``k`` of largest product are its negatives, none where there are
    fewer. Then it enters the bank, whose oldest arrival leaves. The bank is a list state of ``size`` entries."""

    def __init__(self, size: int, k: int):
        self.size, self.k = size, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bank = handle.getListState("bank", "seq long, sku_id long, vec binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.bank.get()]
        some = pd.concat(list(rows))
        pieces = [np.frombuffer(x, np.int64) for x in some["seqs"]]
        seq, sku = np.concatenate(pieces), np.concatenate([np.frombuffer(x, np.int64) for x in some["skus"]])
        v = np.concatenate([np.frombuffer(x, np.float32 if single else np.float64).reshape(len(n), -1) for x, single, n in zip(some["vecs"], some["single"], pieces)])
        # A micro-batch has no order of its own. Its rows are bounded by the source's rate limit.
        order = np.argsort(seq, kind="stable")
        seq, sku = seq[order], sku[order]
        if held:
            old = np.frombuffer(b"".join(r[2] for r in held), np.float64).reshape(len(held), -1)
            with np.errstate(over="ignore"):
                one = old.astype(v.dtype)
            v = np.concatenate([one if (one == old).all() else old, v])
            seq, sku = np.concatenate([[r[0] for r in held], seq]), np.concatenate([[r[1] for r in held], sku])
            order = np.concatenate([np.arange(len(held)), len(held) + order])
        last = v[order[-self.size :]].astype(np.float64)
        self.bank.put([(int(a), int(b), c.tobytes()) for a, b, c in zip(seq[-self.size :], sku[-self.size :], last)])
        out = self.mined(seq, sku, v, order, len(held))
        yield out.assign(bank=key[0])[["bank", "seq", "rank", "negative", "similarity"]]

    def mined(self, seq: np.ndarray, sku: np.ndarray, v: np.ndarray, order: np.ndarray, first: int) -> pd.DataFrame:
        """Negatives of the rows from ``first`` on, a stretch of rows at a time; their vectors are at the places ``order`` of ``v``."""
        stretch, out = max(64, min(256, self.size)), []
        for at in range(first, len(seq), stretch):
            to = min(at + stretch, len(seq))
            low = max(0, at - self.size)
            x = v[order[low:to]].astype(np.float64)
            near = np.round(x[at - low :] @ x.T, 12)
            turn, place = np.arange(at, to)[:, None], np.arange(low, to)[None, :]
            near[(place >= turn) | (place < turn - self.size) | (sku[at:to, None] == sku[None, low:to])] = -np.inf
            some = np.flatnonzero(np.count_nonzero(near > -np.inf, axis=1) >= self.k)
            near = near[some]
            if self.k > 16:
                best = np.argsort(-near, axis=1, kind="stable")[:, : self.k]
                score = np.take_along_axis(near, best, axis=1)
            else:  # the largest, so many times
                best, score, row = np.empty((len(some), self.k), np.int64), np.empty((len(some), self.k)), np.arange(len(some))
                for n in range(self.k):
                    best[:, n] = near.argmax(axis=1)  # rows are in the order of seq, so ties go to the smaller
                    score[:, n] = near[row, best[:, n]]
                    near[row, best[:, n]] = -np.inf
            out.append((seq[at + some], seq[low:to][best], score))
        mined, negative, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros((0, self.k), np.int64), np.zeros((0, self.k)))
        return pd.DataFrame({"seq": np.repeat(mined, self.k), "rank": np.tile(np.arange(1, self.k + 1), len(mined)), "negative": negative.ravel(), "similarity": score.ravel()})


PACKED = "bank string, seqs binary, skus binary, vecs binary, single boolean"


def pack_arrivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ``PACKED`` for each bank of an Arrow batch: a stateful processor takes its input row by row, so few long rows. Vectors that are single-precision numbers are
    packed as such."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bank = batch.column("bank").dictionary_encode()
        code, names = bank.indices.fill_null(-1).to_numpy(zero_copy_only=False), bank.dictionary.to_pylist()
        seq, sku = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seq", "sku_id"))
        v = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            one = v.astype(np.float32)
        single = bool((one == v).all())
        v = (one if single else v.astype(np.float64)).reshape(len(seq), -1)
        out = []
        for c in np.unique(code):
            at = np.flatnonzero(code == c)
            out.append((None if c < 0 else names[c], seq[at].tobytes(), sku[at].tobytes(), v[at].tobytes(), single))
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def mine_stream(arrivals: DataFrame, size: int, k: int) -> DataFrame:
    """(bank, seq, rank, negative, similarity) for a stream of arrivals (bank string, seq, sku_id, vec) whose micro-batches come in the order of
    ``seq``: the same rows however the stream is cut into micro-batches or restarted. Arrivals without a vector are no arrivals."""
    use_keyed_state(arrivals.sparkSession)
    packed = arrivals.filter("vec is not null").select("bank", "seq", "sku_id", "vec").mapInArrow(pack_arrivals, PACKED)
    return packed.groupBy("bank").transformWithStateInPandas(
        BankMiner(size, k), "bank string, seq long, rank long, negative long, similarity double", "Append", "None")


class BestSoFar(StatefulProcessor):
    """The best value of each run before each of its epochs, in a value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("epoch")
        value = new["value"].to_numpy(np.float64)
        start = self.best.get()[0] if self.best.exists() else np.nan
        upto = np.fmax.accumulate(np.concatenate([[start], value]))
        if not np.isnan(upto[-1]):
            self.best.update((float(upto[-1]),))
        best = upto[:-1]
        improved = ~(value <= best)  # also where either is missing
        yield pd.DataFrame({"run": key[0], "epoch": new["epoch"].to_numpy(), "value": value, "best": [None if np.isnan(x) else float(x) for x in best], "improved": improved})


def best_stream(history: DataFrame) -> DataFrame:
    """(run, epoch, value, best, improved) for a stream of (run, epoch, value) whose micro-batches come in the order of epochs."""
    use_keyed_state(history.sparkSession)
    return history.groupBy("run").transformWithStateInPandas(
        BestSoFar(), "run long, epoch long, value double, best double, improved boolean", "Append", "None")
