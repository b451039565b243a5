"""Exact top-k that visits cells best first and stops where no cell can improve.

Items lie in cells, cut into parts of bounded size and packed, a row for each part. A query ranks the cells by the largest
product that any of their items can have with it, and visits a few of them a round. Its k-th best so far closes all cells
whose bound is under it; a query is done when none is open. Rounds double what a query may visit, and where a round closes little,
the next one visits all that is open: vectors without structure cost two passes, not one for each cell.

A round is a join of visits with the parts of the cells that they name, and tables between rounds are stored: nothing but the cells' centres
is held by the driver, and each task holds one part and a bounded set of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators.blocks import Best, top_k
from lapwing.operators.cells import Cells, angles, cell_count, centres_of, measured, placed, sample_of, sampled_centres, units, unpack
from lapwing.sources.shared import stored

NEAR = "query_id long, item_id long, similarity double"


@dataclass(frozen=True)
class CellIndex:
    """``rows`` (item_id, vec packed, cell, angle, norm) and their cells."""

    rows: DataFrame
    cells: Cells


def cell_index(items: DataFrame, n_cells: int | None = None, centres: np.ndarray | None = None) -> CellIndex:
    """The index of ``items`` (item_id, vec), around ``centres``, or in ``n_cells`` cells or as many as suit their number."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "vec").filter("vec is not null")
    centres = sampled_centres(items, n_cells) if centres is None else centres
    if not len(centres):
        return CellIndex(placed(items, np.zeros((1, 1))), Cells(np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.zeros(1, np.int64)))
    rows = stored(placed(items, centres), "cells")
    return CellIndex(rows, measured(rows, centres))


def packed_parts(index: CellIndex, part_rows: int) -> DataFrame:
    """(cell, part, ids, vecs): the rows of each part of a cell in two packed columns."""
    names = [(c, max(1, -(-int(n) // part_rows))) for c, n in enumerate(index.cells.rows)]
    parts = index.rows.sparkSession.createDataFrame(names, "cell int, parts int")  # a row for each cell
    rows = index.rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), "parts").cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "parts": [pdf["parts"].iloc[0]], "ids": [pdf["item_id"].to_numpy(np.int64).tobytes()], "vecs": [b"".join(pdf["vec"])]})

    return rows.select("cell", "part", "parts", "item_id", "vec").groupBy("cell", "part").applyInPandas(pack, "cell int, part int, parts int, ids binary, vecs binary")


def _orders(queries: DataFrame, cells: Cells) -> DataFrame:
    """``queries`` packed, with ``cells`` in the order of their bounds, largest first, and the bounds."""
    held = np.flatnonzero(cells.rows)

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                q = np.array(part["vec"].tolist(), np.float64)
                bounds = cells.bounds(q, held)
                rank = np.argsort(-bounds, axis=1, kind="stable")
                yield pd.DataFrame({
                    "query_id": part["query_id"], "vec": [x.tobytes() for x in q], "open": [held[r].astype(np.int32) for r in rank],
                    "bounds": [b[r] for b, r in zip(bounds, rank)],
                })

    return queries.filter("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).mapInPandas(order, "query_id long, vec binary, open array<int>, bounds array<double>")


def _visited(visits: DataFrame, parts: DataFrame, k: int, drop_self: bool, digits: int, query_rows: int, threshold: float | None = None, earlier: bool = False) -> DataFrame:
    """The best items of each query (query_id, vec) in each part of the cells that it visits; with ``threshold``, those that reach it (to ``digits`` places), and with
    ``earlier``, those of smaller ids only."""

    def best(pdf_q: pd.DataFrame, pdf_p: pd.DataFrame) -> pd.DataFrame:
        if pdf_q.empty or pdf_p.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        ids, own = np.frombuffer(pdf_p["ids"].iloc[0], np.int64), pdf_q["query_id"].to_numpy(np.int64)
        v = np.frombuffer(pdf_p["vecs"].iloc[0], np.float64).reshape(len(ids), -1)
        best = Best(own, unpack(pdf_q["vec"]), k, drop_self, digits, turns=own if earlier else None, floor=-np.inf if threshold is None else threshold)
        best.meet(ids, v, turns=ids if earlier else None)
        return best.found()

    sizes = parts.select("cell", F.col("parts").alias("n")).distinct()
    asks = visits.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    asked = asks.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("sets")).withColumnRenamed("cell", "c")
    asks = asks.join(F.broadcast(asked), F.col("cell") == F.col("c")).withColumn("set", F.pmod(F.xxhash64("query_id"), "sets").cast("int"))
    rows = parts.join(F.broadcast(asked), F.col("cell") == F.col("c")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)))
    rows = rows.select(F.col("cell").alias("a"), F.col("part").alias("b"), "s", "ids", "vecs")
    return asks.select("cell", "part", "set", "query_id", "vec").groupBy("cell", "part", "set").cogroup(rows.groupBy("a", "b", "s")).applyInPandas(best, NEAR)


def bounded_top_k(queries: DataFrame, index: CellIndex, k: int, drop_self: bool = True, digits: int = 12, first: int = 4, part_rows: int = 20_000, query_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The ``k`` items of largest product for each of ``queries`` (query_id, vec), query_id, rank, item_id, similarity, as exact search finds
    them (ties, to ``digits`` places, go to the smaller item_id); and how many ``cells`` each query visited."""
    spark = queries.sparkSession
    if not index.cells.rows.any():
        return spark.createDataFrame([], "query_id long, rank int, item_id long, similarity double"), queries.select("query_id", F.lit(0).alias("cells"))
    state = stored(_orders(queries, index.cells).withColumns({"at": F.lit(0), "floor": F.lit(float("-inf"))}), "open")
    parts = stored(packed_parts(index, part_rows), "parts")
    least = 0.5 * 10.0**-digits  # bounds hold for products before they are rounded
    best, step = None, first
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    n_cells = int((index.cells.rows > 0).sum())
    while True:
        # Bounds fall along the order, so what is open is a stretch from ``at`` on.
        state = state.withColumn("end", F.greatest("at", F.size(F.filter("bounds", lambda b: b >= F.col("floor") - least))))
        some = F.least(F.col("end"), F.col("at") + step)
        visits = state.filter(F.col("at") < F.col("end")).select("query_id", "vec", F.explode(F.slice("open", F.col("at") + 1, some - F.col("at"))).alias("cell"))
        found = _visited(visits, parts, k, drop_self, digits, query_rows).withColumn("similarity", F.round("similarity", digits))
        found = found if best is None else found.unionByName(best)
        best = stored(found.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= k).drop("n"), "best")
        last = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("similarity")).alias("last")).withColumnRenamed("query_id", "q")
        state = state.withColumn("at", some).join(last, F.col("query_id") == F.col("q"), "left")
        state = stored(state.select("query_id", "vec", "open", "bounds", "at", F.coalesce("last", F.lit(float("-inf"))).alias("floor")), "open")
        left = F.greatest(F.size(F.filter("bounds", lambda b: b >= F.col("floor") - least)) - F.col("at"), F.lit(0))
        still, more = state.agg(F.count(F.when(left > 0, 1)), F.sum(left)).first()
        if not still:
            break
        step = n_cells if more > 0.5 * still * (n_cells - step) else 2 * step
    out = best.withColumn("rank", F.row_number().over(ranked)).select("query_id", "rank", "item_id", "similarity")
    return out, state.select("query_id", F.col("at").alias("cells"))


def open_share(queries: DataFrame, items: DataFrame, k: int, most_queries: int = 256, same: bool = False) -> tuple[float, np.ndarray]:
    """Which share of the cells a query has to visit, estimated on samples of both (1 where either is empty), and the centres. The k-th best of a sample is a floor
    of the k-th best of all. ``same``: the queries are the items, so one sample, by least hash, holds the other."""
    ids, sample = sample_of(items, "item_id")
    asked, q = (ids[:most_queries], sample[:most_queries]) if same else sample_of(queries, "query_id", most_queries)
    if len(ids) <= k or not len(asked):
        return 1.0, np.zeros((0, 0))
    centres = centres_of(sample, cell_count(len(sample)))
    apart = angles(units(sample), centres)
    cell, norm = np.argmin(apart, axis=1), np.linalg.norm(sample, axis=1)
    radius, longest = np.zeros(len(centres)), np.zeros(len(centres))
    np.maximum.at(radius, cell, apart[np.arange(len(cell)), cell])
    np.maximum.at(longest, cell, norm)
    near = q @ sample.T
    near[asked[:, None] == ids[None, :]] = -np.inf
    floor = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
    cells = Cells(centres, radius, longest, np.bincount(cell, minlength=len(centres)))
    return float((cells.bounds(q) >= floor[:, None]).mean()), centres


def nearest(queries: DataFrame, items: DataFrame, k: int, drop_self: bool = True, digits: int = 12, worthwhile: float = 0.3, same: bool = False, floor: float = -np.inf) -> DataFrame:
    """The rows of ``blocks.top_k``, by the search over cells where samples say that a query visits under the ``worthwhile`` share of them, else by a scan of all items.
    Items under ``floor`` may be left out."""
    share, centres = open_share(queries, items, k, same=same)
    if share > worthwhile:
        return top_k(queries, items, k, drop_self, digits, same=same, floor=floor)
    return bounded_top_k(queries, cell_index(items, centres=centres), k, drop_self, digits)[0]
