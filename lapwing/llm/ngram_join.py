"""N-gram Jaccard join by MinHash banding, verified on whole n-gram sets.

1. Each text becomes its set of word n-grams; equal sets are one class (least doc_id as its
   representative), so copies never meet each other again.
2. ``bands`` of ``rows`` minima, chosen for the target recall at the threshold; representatives
   are shuffled on band hashes, and buckets of two or more are kept.
3. A pair that shares several buckets is settled in the first band that it shares. A pass over
   band hashes alone finds which representatives have such a pair in which bucket; only those
   are sent their n-gram sets, from the text.
4. Buckets are verified by exact intersection counts. One that is large (in members or in n-grams)
   is split into blocks, and every pair of blocks is a bucket of its own, of bounded size. Buckets
   return counts of links and a spanning forest, never pairs.
5. Forest edges give the connected components.

Defined results for odd input: a text without words (or null) has no links and is a class of its
own row; a text of 1 to n-1 words has its whole word sequence as the one n-gram; a row without
doc_id gets the class of its text and is no representative where another has an id; repeated rows
are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.common import U64, mix64, partitions, semi_join, table
from lapwing.llm.components import components
from lapwing.llm.shingles import WordHashes, minhash, shingle_set


def choose_bands(threshold: float, recall: float, most: int = 512) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with ``recall`` or better: the most rows (fewest false
    candidates) for which the hashes stay within ``most`` and the bands within a third of it."""
    best = (1, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most and bands <= most // 16:
            best = (max(1, bands), rows)
    return best


def _signed(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, bands * rows, dtype=U64) * U64(2) + U64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=U64)
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, keys, signed = [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(hashes.of(text), n)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    low, band = minhash(s, a, b).reshape(bands, rows), np.zeros(bands, U64)
                    for r in range(rows):
                        band = mix64(band * U64(31) + low[:, r])
                    signed.append(band.tobytes())
                else:
                    signed.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())],
                ["doc_id", "n", "set_key", "bands"],
            )


def _exploded(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = batch.num_rows
        h = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(bands, dtype=np.int32), m)), pa.array(h), pa.array(np.repeat(batch.column("rep").to_numpy(), bands)),
             pa.array(np.repeat(batch.column("n").to_numpy(), bands))],
            ["band", "h", "rep", "n"],
        )


def _matrix(bands: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bands), U64).reshape(len(bands), -1)


def _met(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Whether rows of ``x`` and ``y`` share a band before ``band``."""
    out = np.zeros((len(x), len(y)), bool)
    for e in range(band):
        out |= x[:, e][:, None] == y[:, e][None, :]
    return out


BUCKET = ["band", "h", "i", "j"]


def _buckets(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, tuple, np.ndarray, np.ndarray]]:
    """Each bucket's rows of a shard, its key, and the places in them of the two blocks that it compares."""
    order = np.lexsort([pdf[c].to_numpy() for c in reversed(BUCKET)])
    keys = [pdf[c].to_numpy()[order] for c in BUCKET]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    block = pdf["block"].to_numpy()[order]
    starts = np.flatnonzero(new)
    for at, to in zip(starts, [*starts[1:], len(order)]):
        key = tuple(int(k[at]) for k in keys)
        yield order[at:to], key, np.flatnonzero(block[at:to] == key[2]), np.flatnonzero(block[at:to] == key[3])


def _needed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members that have a pair whose first common band is their bucket's."""
    every = _matrix(pdf["bands"])
    use = np.zeros(len(pdf), bool)
    for rows, (band, *_), left, right in _buckets(pdf):
        bands = every[rows]
        if len(rows) == 2:
            use[rows] = not (bands[0, :band] == bands[1, :band]).any()
            continue
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            new = ~_met(bands[some], bands[right], band)
            new &= some[:, None] != right[None, :]
            use[rows[some[new.any(axis=1)]]] = True
            use[rows[right[new.any(axis=0)]]] = True
    return pdf.loc[use, [*BUCKET, "block", "rep"]]


LINKS = "rep long, root long, links long, docs long"


def _verified(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts of links of each member, and forest edges, among the pairs first met in the shard's buckets."""
    every, grams = _matrix(pdf["bands"]), pdf["grams"].to_numpy()
    reps, sizes, copies = pdf["rep"].to_numpy(), pdf["n"].to_numpy().astype(np.int64), pdf["copies"].to_numpy()
    out = [_links(reps[r], sizes[r], copies[r], every[r], grams[r], key, left, right, threshold) for r, key, left, right in _buckets(pdf)]
    columns = map(np.concatenate, zip(*out)) if out else [np.empty(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("rep", "root", "links", "docs"), columns)))


def _links(
    reps: np.ndarray, n: np.ndarray, copies: np.ndarray, bands: np.ndarray, grams: np.ndarray, key: tuple, left: np.ndarray, right: np.ndarray,
    threshold: float,
) -> tuple[np.ndarray, ...]:
    """(member, root, links, linked documents) of one bucket."""
    band, _, i, j = key
    m = len(reps)
    all_sets = np.frombuffer(b"".join(grams), U64)
    _, column, times = np.unique(all_sets, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), n)
    shared = times > 1
    column_of = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], column_of[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    start = 0
    while start < len(column):  # a slice of columns at a time: exact counts, as float32 holds integers to 2**24
        first = column[start]
        stop = int(np.searchsorted(column, first + 4096))
        present = np.zeros((m, min(4096, int(column[-1] - first) + 1)), np.float32)
        present[owner[start:stop], column[start:stop] - first] = 1
        common += present[left] @ present[right].T
        start = stop
    union = n[left][:, None] + n[right][None, :] - common
    links = (common / union >= threshold - 1e-12) & ~_met(bands[left], bands[right], band)
    links &= (left[:, None] < right[None, :]) if i == j else True
    a, b = np.nonzero(links)
    a, b = left[a], right[b]
    degree, docs = np.bincount(a, minlength=m) + np.bincount(b, minlength=m), np.zeros(m, np.int64)
    np.add.at(docs, a, copies[b])
    np.add.at(docs, b, copies[a])
    root = np.arange(m)
    rank = np.argsort(np.argsort(reps, kind="stable"), kind="stable")
    by_rank = np.argsort(rank)
    root = rank.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[by_rank[root]])
        if (before == root).all():
            break
    hit = degree > 0
    return reps[hit], reps[by_rank[root[hit]]], degree[hit].astype(np.int64), docs[hit]


def _grams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(hashes.of(t), n).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
            keys = [xxhash.xxh3_128_digest(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.binary())], ["rep", "grams", "key"])


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block_members: int = 1024, block_grams: int = 2_000_000, shard_rows: int = 20_000,
    shard_grams: int = 4_000_000,
) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, ``rep_id`` (least doc_id with the same n-gram set), ``class_id``
    (least doc_id of the connected component), ``n_links`` (other n-gram sets at the threshold or more),
    ``n_linked_docs`` (documents of these and copies of its own) and ``n_grams``."""
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    signed = table(texts.mapInArrow(lambda b: _signed(b, n, bands, rows), "doc_id long, n int, set_key binary, bands binary"), "signed")
    classes = signed.filter("n > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = table(classes, "classes")
    known = classes.filter("rep is not null")

    entries = known.select("rep", "n", "bands").mapInArrow(lambda b: _exploded(b, bands), "band int, h long, rep long, n int")
    buckets = entries.groupBy("band", "h").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).filter("m > 1")
    buckets = table(buckets, "buckets")
    size = buckets.agg(F.sum("m"), F.sum("grams")).first()
    # A shard's task holds its members' n-gram sets, so these count as well as the members.
    shards = max(2 * partitions(docs.sparkSession), (size[0] or 0) // shard_rows, (size[1] or 0) // shard_grams)
    buckets = buckets.select("band", "h", F.greatest(F.ceil(F.col("m") / block_members), F.ceil(F.col("grams") / block_grams)).cast("int").alias("blocks"))
    members = entries.join(buckets, ["band", "h"]).select("band", "h", "rep", "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", "h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    members = members.join(known.select("rep", "bands"), "rep")
    shard = F.pmod(F.xxhash64(*BUCKET), F.lit(shards))
    needed = members.groupBy(shard).applyInPandas(_needed, "band int, h long, i int, j int, block int, rep long")
    needed = table(needed, "needed")

    wanted = needed.select(F.col("rep").alias("doc_id")).distinct()
    sets = semi_join(texts, wanted, "doc_id").mapInArrow(lambda b: _grams(b, n), "rep long, grams binary, key binary")
    # A doc_id that stands for several texts is told apart by the key of its class.
    full = needed.join(known.select("rep", "n", "copies", "bands", "set_key"), "rep").join(sets, "rep").filter(F.col("set_key") == F.col("key"))
    found = full.drop("set_key", "key").groupBy(shard).applyInPandas(lambda pdf: _verified(pdf, threshold), LINKS)
    found = table(found, "links")

    degrees = found.groupBy("rep").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    groups = classes.select("set_key", "rep", "copies").join(degrees, "rep", "left").join(roots, "rep", "left")
    out = signed.select("doc_id", "n", "set_key").join(groups, "set_key", "left")
    return out.select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("root", "rep", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("docs", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_linked_docs"),
        F.col("n").cast("long").alias("n_grams"),
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates (the least doc_id), all columns. Rows without doc_id stay."""
    found = near_duplicates(docs, n, threshold)
    kept = found.filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    once = Window.partitionBy("doc_id", F.md5("text")).orderBy(F.lit(0))
    known = docs.join(kept, docs["doc_id"] == F.col("kept_id"), "left_semi").withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").drop("_nth")
    return known.unionByName(docs.filter(docs["doc_id"].isNull()))
