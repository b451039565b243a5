"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed by ``tables`` independent sets of Gaussian (2-stable) projections cut into
cells of ``width``. A query visits its own cell and then perturbed cells, in the order of their
estimated success: the sum of squared distances to the cell boundaries crossed. Candidates of all
tables meet in one exact reranking by cosine in double precision on the stored vectors.

* The number of probes is fitted on a bounded sample (``sample_rows`` rows and ``sample_queries``
  queries, lowest hashes of ids) to a recall target; every row is indexed.
* Copies of one vector are cut to the ``k + 1`` smallest ids before the index is built; no query can
  return more of them, so nothing is lost.
* Buckets are counted; one over ``bucket_rows`` rows is split into that many sub-buckets, and a probe
  visits them all. Work is grouped in blocks of buckets of bounded size; a block returns the few best
  rows of each query, never pairs. Queries are cut into sets of bounded size, each a group with every block that it visits.
* A query that found fewer than ``k`` neighbours is compared with every block of the first table; so are all, where the
  largest number of probes does not reach the recall on the sample.

Defined results for odd input: vectors that are null, zero, hold null or non-finite components, or are
not of the table's most common length take no part, nor do rows without an id. Repeated rows are one
row; rows with one id and different vectors are each a candidate, their id counts once by its best
score, and as a query the smallest of the vectors stands for the id. A query's own id is never its
candidate. No valid vector or no query: no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.common import mix64, table
from lapwing.sources.shared import least_hashes


@dataclass(frozen=True)
class Hashes:
    """``tables`` sets of ``functions`` projections of vectors of ``dim`` components."""

    dim: int
    tables: int = 4
    functions: int = 8
    width: float = 2.5
    seed: int = 20240229

    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.tables, self.dim, self.functions)), rng.uniform(0, self.width, (self.tables, self.functions))

    def places(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Positions of the rows along table ``t``'s functions, in cells."""
        a, b = self.planes()
        return (unit @ a[t] + b[t]) / self.width


def bucket_ids(cells: np.ndarray, t: int) -> np.ndarray:
    """A 64-bit id of each row of cell numbers."""
    out = np.full(len(cells), t + 1, np.uint64)
    for column in cells.astype(np.int64).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column.view(np.uint64))
    return out.view(np.int64)


def probe_cells(place: np.ndarray, probes: int) -> np.ndarray:
    """Cells to visit for one query, most promising first: steps of up to two cells along each function,
    sets of steps taken from a heap by their summed squared boundary distance."""
    home = np.floor(place).astype(np.int64)
    inside = place - home
    steps = sorted(
        ((inside[i] - d - 1 if d < 0 else d - inside[i]) ** 2, i, d)
        for i in range(len(place)) for d in (-2, -1, 1, 2)
    )
    found = [home]
    heap = [(steps[0][0], (0,))]
    probes = min(probes, 5 ** len(place))  # as many cells as there are
    while heap and len(found) < probes:
        score, chosen = heapq.heappop(heap)
        # Two steps along one function make no cell. Only the last step of a set can clash, and then nothing is added to the set.
        if valid := len({steps[j][1] for j in chosen}) == len(chosen):
            cell = home.copy()
            for j in chosen:
                cell[steps[j][1]] += steps[j][2]
            found.append(cell)
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (score - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            if valid:
                heapq.heappush(heap, (score + steps[last + 1][0], (*chosen, last + 1)))
    return np.array(found)


def _scaled(rows: pd.Series) -> np.ndarray:
    """Vectors times the power of two that brings their largest component to 1/2 or more: cosines stay the same to the last bit, and
    squares neither vanish nor overflow."""
    x = np.array(rows.tolist(), dtype=np.float64)
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def _unit(rows: pd.Series) -> np.ndarray:
    x = _scaled(rows)
    return x / np.linalg.norm(x, axis=1)[:, None]


def fit_probes(sample: np.ndarray, queries: np.ndarray, hashes: Hashes, k: int, recall: float, most: int = 4096) -> int | None:
    """Fewest probes, in steps of a half, that reach ``recall`` on unit-vector samples (queries are rows of the sample's space);
    none if ``most`` do not."""
    near = queries @ sample.T
    near[near > 1 - 1e-12] = -2  # a query that is in the sample
    truth = np.argsort(-near, axis=1)[:, :k]
    probes = 8
    orders = [[bucket_ids(probe_cells(p, most), t) for p in hashes.places(queries, t)] for t in range(hashes.tables)]
    kept = [bucket_ids(np.floor(hashes.places(sample, t)), t) for t in range(hashes.tables)]
    while probes < most:
        hits = sum(
            np.isin(truth[i], np.flatnonzero(np.any([np.isin(kept[t], orders[t][i][:probes]) for t in range(hashes.tables)], axis=0))).sum()
            for i in range(len(queries))
        )
        if hits >= recall * truth.size:
            return probes
        probes = probes * 3 // 2
    return None


def _index(batches: Iterator[pd.DataFrame], hashes: Hashes) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            unit = _unit(pdf["vec"])
            for t in range(hashes.tables):
                yield pd.DataFrame({"t": t, "bucket": bucket_ids(np.floor(hashes.places(unit, t)), t), "vec_id": pdf["vec_id"], "vec": pdf["vec"]})


def _probes(batches: Iterator[pd.DataFrame], hashes: Hashes, probes: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            unit = _unit(part["qvec"])
            for t in range(hashes.tables):
                cells = [probe_cells(p, probes) for p in hashes.places(unit, t)]
                yield pd.DataFrame({
                    "t": t, "bucket": np.concatenate([bucket_ids(c, t) for c in cells]),
                    "query_id": np.repeat(part["query_id"].to_numpy(), [len(c) for c in cells]),
                })


def _block(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best rows of each query among the block's buckets that it probes."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if rows.empty or asks.empty:
        return none
    v, ids = _scaled(rows["vec"]), rows["vec_id"].to_numpy()
    q, qids = _scaled(asks["qvec"]), asks["query_id"].to_numpy()
    v_norm, q_norm = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
    v_unit, q_unit = v / v_norm[:, None], q / q_norm[:, None]
    order = np.argsort(rows["part"].to_numpy(), kind="stable")
    parts, starts = np.unique(rows["part"].to_numpy()[order], return_index=True)
    members = dict(zip(parts.tolist(), np.split(order, starts[1:])))
    visits: dict[int, list[int]] = {}
    for i, asked in enumerate(asks["parts"]):
        for part in asked:
            visits.setdefault(int(part), []).append(i)
    out = []
    for part, who in visits.items():
        if (m := members.get(part)) is None:
            continue
        m = m[np.argsort(ids[m], kind="stable")]
        own, first = np.unique(ids[m], return_index=True)
        for at in range(0, len(who), 512):
            w = np.array(who[at : at + 512])
            near = q_unit[w] @ v_unit[m].T
            near[qids[w][:, None] == ids[m][None, :]] = -9
            if len(own) > k:
                # All rows that may be among the best k ids: an id counts by its best row, and exact scores may differ from the
                # product's in the last places. However many tie, all are scored.
                best = np.maximum.reduceat(near, first, axis=1) if len(own) < len(m) else near
                least = np.partition(best, len(own) - k, axis=1)[:, len(own) - k]
                keep = (near >= least[:, None] - 1e-9) & (near > -9)
            else:
                keep = near > -9
            for some in np.array_split(np.arange(len(w)), -(-int(keep.sum()) // 200_000) or 1):
                a, b = np.nonzero(keep[some])
                a, b = w[some[a]], m[b]
                score = np.einsum("ij,ij->i", q[a], v[b]) / (q_norm[a] * v_norm[b])
                out.append(_first(qids[a], ids[b], score, k))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), _first(*map(np.concatenate, zip(*out)), k)))) if out else none


def _first(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each query, each id by its best score, ties to the smaller id."""
    order = np.lexsort((-score, row, query))
    query, row, score = query[order], row[order], score[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
    query, row, score = query[once], row[once], score[once]
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    _, first, size = np.unique(query, return_index=True, return_counts=True)
    use = np.arange(len(query)) - np.repeat(first, size) < k
    return query[use], row[use], score[use]


FOUND = "query_id long, vec_id long, score double"


def valid_vector(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.97, tables: int = 4, width: float = 2.5,
    sample_rows: int = 8192, sample_queries: int = 64, bucket_rows: int = 20_000, query_rows: int = 20_000,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, embedding) found for each row of ``queries`` (same columns):
    query_id, rank from 1, vec_id, score. Ties go to the smaller vec_id."""
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).filter(F.col("vec_id").isNotNull() & valid_vector(F.col("vec")))
    common = base.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not common:
        return empty
    dim, rows = common[0]["dim"], common[0]["count"]
    base = base.filter(F.size("vec") == dim)
    same = Window.partitionBy("vec").orderBy("vec_id")
    base = base.distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")
    base = table(base, "vectors")
    asks = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("qvec"))
    asks = asks.filter(F.col("query_id").isNotNull() & valid_vector(F.col("qvec")) & (F.size("qvec") == dim))
    asks = table(asks.groupBy("query_id").agg(F.min("qvec").alias("qvec")), "queries")

    hashes = Hashes(dim, tables, max(4, round(math.log2(max(2, rows)) / 2)), width)
    sample = least_hashes(base, "vec_id", sample_rows, "vec").toPandas()
    asked = least_hashes(asks, "query_id", sample_queries).toPandas()
    if asked.empty:
        return empty
    probes = fit_probes(_unit(sample["vec"]), _unit(asked["qvec"]), hashes, k, recall)

    vec_type = base.schema["vec"].dataType.simpleString()
    index = base.mapInPandas(lambda b: _index(b, hashes), f"t int, bucket long, vec_id long, vec {vec_type}")
    index = table(index, "index")
    blocks = max(1, rows // bucket_rows)
    # Buckets grow with the rows: their sizes are joined by a shuffle, not sent through the driver to every task.
    sizes = index.groupBy("t", "bucket").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("parts")).hint("merge")
    part_of = lambda salt: F.xxhash64("t", "bucket", salt)
    kept = index.join(sizes, ["t", "bucket"])
    kept = kept.withColumn("part", part_of(F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")))
    kept = kept.withColumn("block", F.pmod("part", F.lit(blocks))).select("t", "block", "part", "vec_id", "vec")
    visits = asks.mapInPandas(lambda b: _probes(b, hashes, probes or 1), "t int, bucket long, query_id long")
    visits = visits.join(sizes, ["t", "bucket"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = visits.withColumn("part", part_of(F.col("salt"))).withColumn("block", F.pmod("part", F.lit(blocks)))
    visits = visits.groupBy("query_id", "t", "block").agg(F.collect_list("part").alias("parts")).join(asks, "query_id")

    sets = max(1, -(-asks.count() // query_rows))

    def near(rows_of: DataFrame, asks_of: DataFrame) -> DataFrame:
        """A group is a block and a set of ``query_rows`` queries or so."""
        rows_of = rows_of.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
        asks_of = asks_of.withColumn("set", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int"))
        return rows_of.groupBy("t", "block", "set").cogroup(asks_of.groupBy("t", "block", "set")).applyInPandas(
            lambda key, a, b: _block(key, a, b, k), FOUND)

    if probes is None:
        found, short = None, asks
    else:
        found = table(near(kept, visits).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
        short = asks.join(found.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti")
    if not short.isEmpty():  # an exact way for the queries whose buckets held too few rows, and for all where probes do not reach the recall
        plain = table(kept.filter("t = 0"), "first-table")
        every = table(plain.select("t", "block", "part").distinct().groupBy("t", "block").agg(F.collect_list("part").alias("parts")), "blocks")
        exact = near(plain, short.crossJoin(every))
        found = (exact if found is None else found.unionByName(exact)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
