"""A search index on disk: centroids, codebook, and rows in a folder for each cell, so that a search reads the cells it probes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators.search import Codebook, _coded, _ranked, _whole, _by_cell, probed


@dataclass(frozen=True)
class StoredIndex:
    """``rows`` of a table partitioned by ``cell``: (item_id, vec, cell) or, with a ``book``, (item_id, codes, cell)."""

    centroids: np.ndarray
    rows: DataFrame
    book: Codebook | None = None


def write_index(path: str, centroids: np.ndarray, rows: DataFrame, book: Codebook | None = None) -> None:
    """Writes an index of ``rows`` (item_id, cell, and vec or codes). A folder that holds one is replaced."""
    spark = rows.sparkSession
    at = lambda name: f"{path.rstrip('/')}/{name}"
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(at("centroids"))
    words = [] if book is None else [(s, k, [float(x) for x in w]) for s, ws in enumerate(book.words) for k, w in enumerate(ws)]
    spark.createDataFrame(words, "sub int, code int, word array<double>").coalesce(1).write.mode("overwrite").parquet(at("codebook"))
    rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(at("rows"))


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    at = lambda name: f"{path.rstrip('/')}/{name}"
    centroids = np.array([r["vec"] for r in spark.read.parquet(at("centroids")).orderBy("cell").collect()])  # a row for each cell
    words = spark.read.parquet(at("codebook")).orderBy("sub", "code").collect()  # a row for each code word
    book = Codebook(np.array([r["word"] for r in words]).reshape(words[-1]["sub"] + 1, words[-1]["code"] + 1, -1)) if words else None
    kind = "codes array<smallint>" if book else "vec array<double>"
    return StoredIndex(centroids, spark.read.schema(f"item_id long, {kind}, cell int").parquet(at("rows")), book)


def probed_rows(index: StoredIndex, queries: DataFrame, nprobe: int) -> DataFrame:
    """The rows of the cells that ``queries`` (query_id, vec) probe. The join with the cells' numbers, as many as there are cells at most, becomes a
    filter on the folders to read."""
    cells = probed(queries, index.centroids, nprobe).filter(F.col("place") < nprobe).select("cell").distinct()
    return index.rows.join(F.broadcast(cells), "cell", "left_semi")


def search_index(queries: DataFrame, index: StoredIndex, nprobe: int, k: int, drop_self: bool = False, part_rows: int = 20_000) -> DataFrame:
    """The ``k`` best rows of the probed cells, by whole vectors or by codes: query_id, rank, item_id, similarity."""
    work = _whole(k, drop_self) if index.book is None else _coded(index.centroids, index.book, k)
    return _ranked(_by_cell(probed(queries, index.centroids, nprobe), probed_rows(index, queries, nprobe), work, part_rows, queries.count()), k)
