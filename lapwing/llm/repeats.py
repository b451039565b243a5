"""Repeated windows across documents: what substring and suffix-array deduplication share.

A window (50 words, or 50 bytes) is keyed by the least hash among the short grams inside it. Equal
windows have equal keys, wherever they stand, so a key that one document holds alone can have no
repeated window; keys change only every couple of dozen positions, so they are few. A *run* is a
stretch of windows under one key; its *context* is the text under the run's windows.

Keys go packed: each task gathers those of a few megabytes of text (a chunk) and sends them, split by hash into shards, which
grow in number with the text. A *code* is a key as exchanged: its shard in the upper bits, what the shard is told below. A key is sent
once per chunk, so a passage in a third of all documents costs a shard one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import U64, mix64, partitions, table
from lapwing.llm.shingles import BASE, WordHashes, grams, window_min

BYTE_HASHES = mix64(np.arange(1, 257, dtype=U64))


@dataclass(frozen=True)
class Windows:
    """Windows of ``width`` words or bytes keyed by their least ``gram``-gram."""

    unit: str
    width: int
    gram: int

    def reader(self) -> Callable[[bytes | None], np.ndarray]:
        """Texts to arrays of unit hashes."""
        if self.unit == "words":
            return WordHashes().of
        return lambda text: BYTE_HASHES[np.frombuffer(text or b"", np.uint8)]

    def runs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, key) of each run."""
        if len(v) < self.width:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
        low = window_min(grams(v, self.gram), self.width - self.gram + 1)
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        return starts, np.diff(np.append(starts, len(low))), low[starts]


    def contents(self, v: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """64-bit hashes of what stands under each run, from prefix sums of the units times powers of an odd base."""
        powers, inverse = _powers(1 << max(16, (len(v)).bit_length()))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(v * powers[: len(v)], dtype=U64)])
        return mix64((sums[starts + lengths - 1 + self.width] - sums[starts]) * inverse[starts] + mix64(lengths.astype(U64)))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, U64), dtype=U64)]) for b in (BASE, U64(pow(int(BASE), -1, 2**64))))


def text_id(text: bytes | None) -> int:
    """Tells texts apart that share a doc_id."""
    return xxhash.xxh3_64_intdigest(text or b"") - 2**63


def codes(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard number in the upper half, 32 bits of the key in the lower. Keys are least hashes, so small numbers are many
    among them: they are mixed anew, to load shards evenly."""
    keys = mix64(keys + U64(1))
    shard = ((keys >> U64(32)) * U64(shards)) >> U64(32)
    return (shard << U64(32)) | (keys & U64(0xFFFFFFFF))


def by_shard(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs of equal numbers in a sorted array."""
    names, first = np.unique(shard, return_index=True)
    return list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(shard)]))


def count_shards(docs: DataFrame, shard_bytes: int) -> int:
    """Shards for one per ``shard_bytes`` of text, a few per shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * partitions(docs.sparkSession), -(-total // shard_bytes), 1)


def home_shard(chunk: int, shards: int) -> int:
    """The shard that a chunk's messages to itself pass through. Chunk numbers hold the partition in their upper half, so they are mixed:
    as they stand, all partitions' first chunks would be one number modulo a power of two."""
    return int(mix64(np.array([chunk], U64))[0] % U64(shards))


#: Bits of a cell's number in a row of a shard's sketch.
CELL = 20


def cells(keys: np.ndarray, shards: int) -> np.ndarray:
    """Codes of the count-min sketch: the shard, and the key's cells in the two rows of the shard's sketch."""
    h = mix64(keys + U64(1))
    shard = ((h >> U64(40)) * U64(shards)) >> U64(24)
    return (shard << U64(2 * CELL)) | (mix64(h ^ U64(0x9E3779B97F4A7C15)) >> U64(64 - 2 * CELL))


#: Kinds of messages: keys of one document of the chunk; keys of several; what is known inside the chunk; its doc_ids.
ONE, SEVERAL, KNOWN, DOCUMENTS = range(4)
MESSAGE = "shard int, chunk long, kind int, places binary, keys binary"
#: A code without its shard, in five bytes.
TOLD = np.dtype([("low", np.uint32), ("high", np.uint8)])


def _packed(code: np.ndarray) -> bytes:
    out = np.empty(len(code), TOLD)
    out["low"], out["high"] = code.astype(np.uint32), (code >> U64(32)).astype(np.uint8)
    return out.tobytes()


def _unpacked(told: bytes) -> np.ndarray:
    told = np.frombuffer(told, TOLD)
    return told["low"].astype(U64) | (told["high"].astype(U64) << U64(32))


def _messages(batches: Iterator[pa.RecordBatch], spec: Windows, shards: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """A chunk's partial sketch, by shard: the cells that its documents' keys touch, apart for keys of one document and of several."""
    read, chunk = spec.reader(), TaskContext.get().partitionId() << 32
    docs: list[int] = []
    keys: list[np.ndarray] = []
    held = 0

    def send() -> pa.RecordBatch:
        nonlocal chunk, docs, keys, held
        owner = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(k) for k in keys])
        code = np.concatenate([*keys, np.empty(0, U64)])
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
        ids = np.array(docs, np.int64)[owner]
        several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start) if len(code) else np.empty(0, bool)
        home = home_shard(chunk, shards)
        rows: list[tuple] = []
        if docs:
            rows.append((home, chunk, DOCUMENTS, b"", np.array(docs, np.int64).tobytes()))
        local = np.repeat(several, np.diff(np.append(start, len(code))))
        if local.any():
            rows.append((home, chunk, KNOWN, owner[local].tobytes(), code[local].tobytes()))
        for kind in (ONE, SEVERAL):
            part = start[several == (kind == SEVERAL)]
            for s, at, to in by_shard((code[part] >> U64(2 * CELL)).astype(np.int64)):
                mine = part[at:to]
                rows.append((s, chunk, kind, owner[mine].tobytes() if kind == ONE else b"", _packed(code[mine])))
        chunk, docs, keys, held = chunk + 1, [], [], 0
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        names = [x.split()[0] for x in MESSAGE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            text = texts[i].as_py()
            if doc_id is None or not text:
                continue
            docs.append(doc_id)
            keys.append(np.unique(cells(spec.runs(read(text))[2], shards)))
            held += len(text)
            if held >= chunk_bytes or len(docs) == 60_000:
                yield send()
    yield send()


def _assembled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk's answers, by document."""
    told, ids = pdf[pdf["kind"] != DOCUMENTS], pdf[pdf["kind"] == DOCUMENTS]
    if told.empty:
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "keys": pd.Series(dtype="object")})
    docs = np.frombuffer(ids["keys"].iloc[0], np.int64)[np.frombuffer(b"".join(told["places"]), np.uint16)]
    code = np.frombuffer(b"".join(told["keys"]), U64)
    order = np.lexsort((code, docs))
    docs, code = docs[order], code[order]
    ids, start = np.unique(docs, return_index=True)
    return pd.DataFrame({"doc_id": ids, "keys": [k.tobytes() for k in np.split(code, start[1:])]})


def estimated_keys(
    docs: DataFrame, spec: Windows, merged: Callable[[list[np.ndarray], list[bool]], list[np.ndarray]], shards: int, chunk_bytes: int = 8_000_000,
) -> DataFrame:
    """(doc_id, keys): for each document, arrays of the codes (``cells``) of its keys that another document may hold. ``merged``
    takes a shard's partial sketches, one array of codes per message, and whether each one's keys are in several documents of their
    chunk, and marks the keys to keep."""

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf[pdf["kind"] <= SEVERAL]
        arrays = [_unpacked(k) for k in asked["keys"]]
        marks = merged(arrays, (asked["kind"] == SEVERAL).tolist())
        rows = [
            (chunk, ONE, np.frombuffer(p, np.uint16)[mark].tobytes(), (k[mark] | (U64(key[0]) << U64(2 * CELL))).tobytes())
            for chunk, kind, p, k, mark in zip(asked["chunk"], asked["kind"], asked["places"], arrays, marks) if kind == ONE and mark.any()
        ]
        passed = pdf.loc[pdf["kind"] > SEVERAL, ["chunk", "kind", "places", "keys"]]
        return pd.concat([pd.DataFrame(rows, columns=passed.columns).astype({"chunk": "int64", "kind": "int32"}), passed])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    sent = rows.mapInArrow(lambda b: _messages(b, spec, shards, chunk_bytes), MESSAGE)
    answers = sent.groupBy("shard").applyInPandas(answer, "chunk long, kind int, places binary, keys binary")
    answers = answers.groupBy("chunk").applyInPandas(_assembled, "doc_id long, keys binary")
    return table(answers.groupBy("doc_id").agg(F.collect_list("keys").alias("keys")), "repeated")


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the half-open intervals."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
