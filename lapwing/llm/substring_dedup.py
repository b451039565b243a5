"""Substring deduplication: a count-min prefilter, then exact grouping of the windows it leaves.

First pass: every document's windows are counted under their keys (see ``repeats``; a key's count is its windows' sum or more) in a
count-min sketch. The sketch is cut into slices of ``2 x 2**20`` cells, and a key's hash names its slice and its cell in either row. Each
chunk of text makes its partial sketch: the cells that its keys touch, once for one document and twice for several. Slices merge what
all chunks have for them, cell by cell, counts held at two, and tell each chunk which of its entries have both cells at two. There are
slices in proportion to the text, so the error (some 2 % of keys pass without being repeated) stays the same at any size and no task
holds the sketch. Neither keys nor windows are exchanged. A count is never too low, for collisions and for windows that
share a key, so no repeated window is lost.

Second pass: only runs of windows whose key was estimated in two documents or more are grouped, by
the hashes of all words of each window, exactly. Equal runs are folded into one with the least
doc_id before their windows are compared. A window is repeated text if it starts in a document with
a smaller doc_id; words under repeated text go.

Defined results for odd input: a null text has no words; a row without doc_id stays whole and
removes nothing; rows that share a doc_id never remove each other's words, and each is judged by its
own text; texts of fewer words than a window stay whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import U64, mix64, table
from lapwing.llm.repeats import CELL, Windows, cells, count_shards, covered, estimated_keys, spans, text_id
from lapwing.llm.shingles import grams


class CountMin:
    """A count-min sketch with saturating counts (two is enough to tell one document from several)."""

    def __init__(self, width: int, depth: int = 2):
        self.width, self.cells = width, np.zeros((depth, width), np.uint8)

    def places(self, keys: np.ndarray) -> np.ndarray:
        rows = [mix64(keys.astype(U64) + (U64(r) << U64(32))) % U64(self.width) for r in range(len(self.cells))]
        return np.array(rows, np.int64)

    def merge(self, keys: np.ndarray, count: int) -> None:
        self.merge_partial(self.places(keys), count)

    def merge_partial(self, places: np.ndarray, count: int) -> None:
        """Add a partial sketch, given by the cells in each row that its entries touch, each ``count`` times."""
        for row, at in zip(self.cells, places):
            touched, times = np.unique(at, return_counts=True)
            row[touched] = np.minimum(row[touched] + times * count, 2)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        return self.least(self.places(keys))

    def least(self, places: np.ndarray) -> np.ndarray:
        return np.min([row[at] for row, at in zip(self.cells, places)], axis=0)


def estimated_repeated(arrays: list[np.ndarray], sure: list[bool]) -> list[np.ndarray]:
    """Merges the partial sketches of a slice and marks the entries that it estimates to be in two documents or more."""
    sketch, mask = CountMin(1 << CELL), U64((1 << CELL) - 1)
    places = [np.array([(code >> U64(CELL)) & mask, code & mask]).astype(np.int64) for code in arrays]
    for at, several in zip(places, sure):
        sketch.merge_partial(at, 2 if several else 1)
    return [sketch.least(at) >= 2 for at in places]


RUNS = "key long, run long, doc_id long, text_id long, start int, n int, windows binary"


def _runs(batches: Iterator[pa.RecordBatch], spec: Windows, shards: int) -> Iterator[pa.RecordBatch]:
    """Runs under repeated keys; the hashes of a run's windows go with its first appearance in the task."""
    read, told = spec.reader(), set()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in RUNS.split(", ")]
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for at in range(0, batch.num_rows, 128):
            rows = []
            for i in range(at, min(at + 128, batch.num_rows)):
                text, doc_id = texts[i].as_py(), batch.column("doc_id")[i].as_py()
                wanted = np.frombuffer(b"".join(batch.column("keys")[i].as_py()), U64)
                v = read(text)
                starts, lengths, keys = spec.runs(v)
                use = np.flatnonzero(np.isin(cells(keys, shards), wanted))
                if not len(use):
                    continue
                windows, tid = grams(v, spec.width), text_id(text)
                for s, n, k in zip(starts[use].tolist(), lengths[use].tolist(), keys[use].view(np.int64).tolist()):
                    packed = windows[s : s + n].tobytes()
                    run = xxhash.xxh3_64_intdigest(packed) - 2**63
                    first = (k, run) not in told
                    if first:
                        if len(told) > 500_000:
                            told.clear()
                        told.add((k, run))
                    rows.append((k, run, doc_id, tid, s, n, packed if first else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            packed = part.column("windows").to_pylist()
            n = np.array([len(p) // 8 for p in packed], np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            repeat = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), n))
            yield pa.RecordBatch.from_arrays(
                [repeat("key"), repeat("run"), pa.array(place.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int64)), repeat("least")],
                ["key", "run", "place", "window", "least"],
            )


def _removed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for at in range(0, batch.num_rows, 128):
            rows = []
            for i in range(at, min(at + 128, batch.num_rows)):
                text = texts[i].as_py() or b""
                words, found, tid = text.split(), batch.column("found")[i].as_py() or [], None
                begin, end = [], []
                if found:
                    tid = text_id(text)
                for f in found:
                    if f["text_id"] != tid:
                        continue
                    if f["places"] is None:
                        begin.append(f["start"])
                        end.append(f["start"] + f["n"] - 1 + width)
                    else:
                        begin += [f["start"] + p for p in f["places"]]
                        end += [f["start"] + p + width for p in f["places"]]
                mask = covered(np.array(begin, np.int64), np.array(end, np.int64), len(words)) if begin else np.zeros(len(words), bool)
                kept = b" ".join(w for w, gone in zip(words, mask.tolist()) if not gone) if begin else b" ".join(words)
                rows.append((batch.column("doc_id")[i].as_py(), len(words), [{"start": a, "stop": b} for a, b in zip(*map(np.ndarray.tolist, spans(mask)))], kept))
            types = (pa.int64(), pa.int64(), pa.list_(span), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)]
            yield pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.string())], ["doc_id", "n_words", "removed", "kept"])


def remove_repeated_words(docs: DataFrame, width: int = 50, gram: int = 8, shard_bytes: int = 16_000_000) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_words, ``removed`` (spans of word numbers, half open)
    and ``kept`` (the other words, joined by single spaces)."""
    spec = Windows("words", width, gram)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    shards = count_shards(texts, shard_bytes)
    keys = estimated_keys(texts, spec, estimated_repeated, shards)
    runs = texts.join(keys, "doc_id").mapInArrow(lambda b: _runs(b, spec, shards), RUNS)
    runs = table(runs, "runs")

    folded = runs.groupBy("key", "run").agg(F.min("doc_id").alias("least"), F.max("windows").alias("windows"), F.max("doc_id").alias("most"))
    folded = table(folded, "folded")
    several = folded.groupBy("key").count().filter("count > 1").select("key")
    # Keys with several different runs: their windows are grouped one by one.
    windows = folded.join(several, "key", "left_semi").mapInArrow(_windows, "key long, run long, place int, window long, least long")
    windows = table(windows, "windows")
    first = windows.groupBy("key", "window").agg(F.min("least").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # A table, so that the join below has nothing but exchanges under it and a window that very many runs share can be split.
    first = table(first, "first-windows")
    mixed = windows.join(first, ["key", "window"]).filter("first < least")
    mixed = mixed.groupBy("key", "run").agg(F.collect_list(F.struct("place", "first")).alias("earlier"))
    known = folded.select("key", "run", "least", "most").join(mixed, ["key", "run"], "left").filter("most > least or earlier is not null")
    hits = runs.drop("windows").join(known, ["key", "run"])
    places = F.transform(F.filter("earlier", lambda e: e["first"] < F.col("doc_id")), lambda e: e["place"])
    hits = hits.withColumn("places", F.when(F.col("least") < F.col("doc_id"), F.lit(None)).otherwise(F.coalesce(places, F.array().cast("array<int>"))))
    hits = hits.filter("places is null or size(places) > 0")
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("text_id", "start", "n", "places")).alias("found"))
    return texts.join(hits, "doc_id", "left").mapInArrow(
        lambda b: _removed(b, width), "doc_id long, n_words long, removed array<struct<start:long,stop:long>>, kept string")
