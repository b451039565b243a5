"""Ranked lexical search over a bit-sliced impact index.

``lexical_index`` keeps, for each segment of documents and each term, the places of the documents that
hold it and how often; impacts depend on counts of the whole corpus, so they are made when the index is
searched. A search takes a block of segments and a batch of items at a time. In a block a bitmap is one
wide integer with a bit for each document; a term's impacts are sliced into one bitmap per binary digit.
An item's scores are such slices too: each of its terms is added to them by bitwise carry arithmetic, all documents
of the block at once. The best ``k`` are found from the most significant slice down: documents that have the digit
move ahead of those that don't, until ``k`` are certain; ties go to the smallest ids. At most ``k`` rows
of each item leave a block.

Memory is one block (``BLOCK_DOCS`` documents or one segment of ``SEGMENT_TERMS`` terms) with the slices of one batch
of items. Nothing of corpus size reaches the driver: it sees three sums and, if there are ``KNOWN_TERMS`` distinct
terms in the items at most, these, so that the index holds them alone; beyond that the index holds every term,
with equal results.

Defined results for odd input: null or empty texts have no terms, are not counted in N and are found by no item; a null
doc_id is a document like others, after all ids in ties; repeated rows are documents each; items without terms (or with
terms that no document holds) have no rows; items of equal item_id, null included, are one item with the terms of all;
further columns of either table are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.common import table

#: Documents and terms at which a segment ends; documents of a block; items of a batch; terms of the items that are sent to all tasks.
SEGMENT_DOCS, SEGMENT_TERMS, BLOCK_DOCS, BATCH_ITEMS, KNOWN_TERMS = 8192, 4_000_000, 16_384, 256, 200_000
INDEX = "segment long, term string, at array<int>, n array<int>, ids array<long>"
FOUND = "item_id long, doc_id long, score long"

#: Each byte as it counts in a term: letters folded, separators as blanks. Bytes of other than ASCII characters all belong to terms.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


class _Names(dict):
    """Term -> number; a term not seen yet takes the next."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)))


def lexical_index(docs: DataFrame, known: list[bytes] | None = None) -> DataFrame:
    """The index of ``docs`` (doc_id, text): a row per segment and term (at: places in the segment, ascending; n: occurrences
    there), and a row per segment without a term (at: 0 and up; n: terms of each document; ids: doc_ids). ``known``: terms to keep, None for all."""
    known = None if known is None else sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = _Names() if known is None else {t: k for k, t in enumerate(known)}
        number = TaskContext.get().partitionId() << 32
        ids, sizes, found, held = [], [], [], 0

        def segment() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            lengths = np.array([len(f) for f in found])
            keys = np.fromiter(chain.from_iterable(found), np.int64, lengths.sum()) * len(found) + np.repeat(np.arange(len(found)), lengths)
            keys, n = np.unique(keys, return_counts=True)
            which, at = keys // len(found), keys % len(found)
            starts = np.flatnonzero(np.diff(which, prepend=-1))
            spell = list(names)
            texts = pa.array([spell[k] for k in which[starts]], pa.binary()).cast(pa.string())
            yield _index_rows(np.full(len(starts), number), texts, _lists(at, starts), _lists(n, starts), pa.nulls(len(starts), pa.list_(pa.int64())))
            one = np.zeros(1, np.int64)
            yield _index_rows(np.array([number]), pa.nulls(1, pa.string()), _lists(np.arange(len(ids)), one), _lists(np.array(sizes), one), pa.array([ids], pa.list_(pa.int64())))
            number, held = number + 1, 0
            for x in (ids, sizes, found):
                x.clear()
            if known is None:
                names.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                words = terms(text.as_py())
                ids.append(doc_id)
                sizes.append(len(words))
                found.append(list(map(names.__getitem__, words)) if known is None else [k for k in map(names.get, words) if k is not None])
                held += len(words)
                if len(ids) >= SEGMENT_DOCS or held >= SEGMENT_TERMS:
                    yield from segment()
        if ids:
            yield from segment()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def _index_rows(segments: np.ndarray, texts: pa.Array, at: pa.Array, n: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(segments.astype(np.int64)), texts, at, n, ids], ["segment", "term", "at", "n", "ids"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of ``items`` (item_id, text), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, t) for i, x in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()) for t in set(terms(x))]
            ids, words = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


def sliced(at: np.ndarray, values: np.ndarray, n: int) -> list[int]:
    """Bitmaps over ``n`` places, one for each binary digit of ``values`` (which stand at the places ``at``), the lowest digit first."""
    digits = np.arange(int(values.max()).bit_length())
    flat = np.zeros((len(digits), n), bool)
    flat[:, at] = values >> digits[:, None] & 1
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(flat, axis=1, bitorder="little")]


def add(total: list[int], slices: list[int]) -> None:
    """Adds ``slices`` to ``total``, both sliced numbers, for all places at once: a carry that ripples up the digits."""
    total.extend([0] * (len(slices) - len(total)))
    carry = 0
    for j, a in enumerate(total):
        b = slices[j] if j < len(slices) else 0
        if j >= len(slices) and not carry:
            return
        odd = a ^ b
        total[j] = odd ^ carry
        carry = a & b | carry & odd
    if carry:
        total.append(carry)


def places(bitmap: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def largest(total: list[int], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``k`` largest sliced numbers above 0, ties to the first places."""
    ahead, level = 0, 0
    for x in total:
        level |= x
    if level.bit_count() > k:
        for x in reversed(total):
            more = ahead | level & x
            if (count := more.bit_count()) > k:
                level &= x
            else:
                ahead, level = more, level & ~x
                if count == k:
                    break
    at = places(ahead, n)
    if len(at) < k:
        at = np.sort(np.append(at, places(level, n)[: k - len(at)]))
    value = np.zeros(len(at), np.int64)
    for j, x in enumerate(total):
        digit = np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8)
        value |= (digit[at >> 3].astype(np.int64) >> (at & 7) & 1) << j
    return at, value


def _searched(postings: pd.DataFrame, segments: pd.DataFrame, n_docs: int, n_terms: int, k: int) -> pd.DataFrame:
    """The best of each item of a batch in a block: ``postings`` (segment, term, at, n, w, items), ``segments`` (home, sizes, ids)."""
    empty = pd.DataFrame({"item_id": [], "doc_id": [], "score": []}).astype({"item_id": "Int64", "doc_id": "Int64", "score": "int64"})
    if postings.empty or segments.empty:
        return empty
    ids = list(chain.from_iterable(segments["ids"]))
    missing = np.array([x is None or x != x for x in ids])
    ids = np.array([0 if gone else int(x) for x, gone in zip(ids, missing)], np.int64)
    size = np.concatenate([np.asarray(x, np.int64) for x in segments["sizes"]])
    first = dict(zip(segments["home"], np.cumsum([0, *map(len, segments["sizes"])])))
    order = np.lexsort((ids, missing))  # places follow ids, so that ties fall to the smallest
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    m = 50 + 50 * size * n_docs // n_terms
    totals: dict[int | None, list[int]] = {}
    for _, rows in postings.groupby("term", sort=False):
        where = np.concatenate([np.asarray(at, np.int64) + first[s] for s, at in zip(rows["segment"], rows["at"])])
        tf = np.concatenate([np.asarray(x, np.int64) for x in rows["n"]])
        impact = int(rows["w"].iloc[0]) * (1_000_000_000 * tf // (1000 * tf + 20 * m[where]))
        if impact.any():
            slices = sliced(place[where], impact, len(ids))
            for item in rows["items"].iloc[0]:
                add(totals.setdefault(None if item is None or item != item else int(item), []), slices)
    found = []
    for item, total in totals.items():
        at, score = largest(total, len(ids), k)
        found.append(pd.DataFrame({"item_id": pd.array([item] * len(at), "Int64"), "doc_id": pd.arrays.IntegerArray(ids[order[at]], missing[order[at]]), "score": score}))
    return pd.concat(found) if found else empty


def lexical_top_k(index: DataFrame, items: DataFrame, k: int = 50, block_docs: int = BLOCK_DOCS, batch_items: int = BATCH_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each of ``items`` (item_id, term)."""
    segments = index.filter("term is null").select(F.col("segment").alias("home"), F.col("n").alias("sizes"), "ids")
    sums = segments.agg(F.sum(F.size("sizes")), F.sum(F.size(F.filter("sizes", lambda n: n > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)))
    rows, n_docs, n_terms = (x or 0 for x in sums.first())
    blocks, batches = max(1, -(-rows // block_docs)), max(1, -(-items.select("item_id").distinct().count() // batch_items))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block")
    postings = index.filter("term is not null").select(block("segment"), "segment", "term", "at", "n")
    df = postings.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    w = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1)))
    asked = items.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(batches)).alias("batch"))
    asked = asked.agg(F.sort_array(F.collect_set(F.struct("item_id"))).alias("i")).select("term", "batch", F.col("i.item_id").alias("items"))
    weighed = asked.join(df.select("term", w.cast("long").alias("w")), "term")
    visits = postings.join(weighed, "term")
    every = segments.select(block("home"), "home", "sizes", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"))
    work = lambda a, b: _searched(a, b, n_docs, max(n_terms, 1), k)
    found = visits.groupBy("block", "batch").cogroup(every.groupBy("block", "batch")).applyInPandas(work, FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` documents (doc_id, text) of highest score for each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    asked = table(item_terms(items), "item-terms")
    words = asked.select("term").distinct()
    known = [r[0].encode() for r in words.collect()] if words.count() <= KNOWN_TERMS else None
    return lexical_top_k(table(lexical_index(docs, known), "lexical-index"), asked, k)


#: The whole score of every document that shares a term with an item.
RANKED_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t),
f AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN g USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50"""
