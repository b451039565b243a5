"""A search index that grows by micro-batches: rows by cell, small batches merged as they gather.

A batch is a folder of rows partitioned by cell. ``fan`` folders of one level are merged into one of the next, so after n batches a reader meets
``fan`` times the logarithm of n folders at most, and a row is rewritten once a level. A search reads the cells that may hold a product at the
threshold: each folder's figures (radius, norm, rows of each cell) prove the others to hold none, so decisions are exact.

Which folders are live after a batch is a small table of its own (a row for each folder and cell). A batch that runs again after a failure starts from the
table of the batch before it and replaces what it wrote; folders are deleted one batch after they were merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapwing.operators.blocks import BLOCK_ROWS, NEAR, Best, met, packed
from lapwing.operators.cells import SINGLE_SLACK, Cells, measured, placed
from lapwing.sources.shared import stored, temporary

ROWS = "item_id long, sku_id long, vec binary, angle double, norm double, level int, batch long, cell int"
FIGURES = "level int, batch long, cell int, radius double, norm double, n long"


@dataclass(frozen=True)
class GrowingIndex:
    path: str
    centres: np.ndarray
    fan: int = 4

    @staticmethod
    def create(spark: SparkSession, path: str, centres: np.ndarray, fan: int = 4) -> GrowingIndex:
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, vec array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return GrowingIndex(path, centres, fan)

    @staticmethod
    def open(spark: SparkSession, path: str, fan: int = 4) -> GrowingIndex:
        return GrowingIndex(path, np.array([r["vec"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]), fan)

    def live(self, spark: SparkSession, batch: int) -> pd.DataFrame:
        """The figures of the folders that are live after ``batch``; none before the first."""
        if batch < 0:
            return pd.DataFrame({c.split()[0]: [] for c in FIGURES.split(", ")})
        return spark.read.schema(FIGURES).parquet(f"{self.path}/live/after={batch}").toPandas()

    def rows(self, spark: SparkSession, live: pd.DataFrame) -> DataFrame:
        """The rows of live folders."""
        folders = sorted({f"{self.path}/rows/level={a}/batch={b}" for a, b in zip(live["level"].astype(int), live["batch"].astype(int))})
        if not folders:
            return spark.createDataFrame([], ROWS)
        return spark.read.schema(ROWS).option("basePath", f"{self.path}/rows").parquet(*folders)

    def cells(self, live: pd.DataFrame) -> Cells:
        figures = [np.zeros(len(self.centres)), np.zeros(len(self.centres)), np.zeros(len(self.centres), np.int64)]
        at = live["cell"].to_numpy(np.int64)
        np.maximum.at(figures[0], at, live["radius"].to_numpy(np.float64))
        np.maximum.at(figures[1], at, live["norm"].to_numpy(np.float64))
        np.add.at(figures[2], at, live["n"].to_numpy(np.int64))
        return Cells(self.centres, *figures)

    def _write(self, rows: DataFrame, level: int, batch: int) -> pd.DataFrame:
        """Rows as a folder, a file for each cell, and its figures."""
        folder = f"{self.path}/rows/level={level}/batch={batch}"
        rows.select("item_id", "sku_id", "vec", "angle", "norm", "cell").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(folder)
        kept = rows.sparkSession.read.schema("angle double, norm double, cell int").parquet(folder)
        figures = kept.groupBy("cell").agg(F.max("angle").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("n")).toPandas()
        return figures.assign(level=level, batch=batch)[[c.split()[0] for c in FIGURES.split(", ")]]

    def add(self, items: DataFrame, batch: int) -> pd.DataFrame:
        """Adds ``items`` (item_id, sku_id, vec) as ``batch`` (numbers rise by one), merges what has gathered, and gives the live folders."""
        spark = items.sparkSession
        before = self.live(spark, batch - 1)
        live = pd.concat([x for x in (before, self._write(placed(items.select("item_id", "sku_id", "vec"), self.centres), 0, batch)) if len(x)] or [before])
        level = 0
        while len(full := live[live["level"] == level]["batch"].unique()) >= self.fan:
            merged = self._write(self.rows(spark, live[live["level"] == level]), level + 1, batch)
            live, level = pd.concat([live[live["level"] != level], merged]), level + 1
        spark.createDataFrame([tuple(r) for r in live.astype(object).itertuples(index=False)], FIGURES).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/after={batch}")
        self._drop(spark, batch, live, before)
        return live

    def _drop(self, spark: SparkSession, batch: int, live: pd.DataFrame, before: pd.DataFrame) -> None:
        """Deletes folders that neither this batch nor the one before holds live."""
        names = lambda x: {(int(a), int(b)) for a, b in zip(x["level"], x["batch"])}
        gone = names(self.live(spark, batch - 2)) - names(live) - names(before) if batch >= 2 else set()
        for level, number in gone:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/level={level}/batch={number}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def near(self, asked: DataFrame, rows: DataFrame, live: pd.DataFrame, threshold: float, k: int) -> DataFrame:
        """(query_id, item_id, similarity): for each of ``asked``, ``packed`` queries, the best of each part of the live rows, ``k`` at most, that reach the threshold."""
        return _near(asked, rows, self.cells(live), threshold, k, False)

    def within(self, asked: DataFrame, items: DataFrame, threshold: float, k: int) -> DataFrame:
        """The same among ``items`` (item_id, vec), which are the queries, each against those of smaller ids."""
        rows = placed(items, self.centres)
        return _near(asked, rows, measured(rows, self.centres), threshold, k, True)


def _near(asked: DataFrame, rows: DataFrame, cells: Cells, threshold: float, k: int, earlier: bool) -> DataFrame:
    """Blocks of queries meet blocks of rows in a Cartesian product, so neither is copied for cells, and a task holds two blocks. What lies in cells that hold nothing at the threshold
    for a query is not multiplied where these are many. Of equal vectors, the ``k`` of least id stand for all: if more come before an item, these do."""
    if not cells.rows.any():
        return asked.sparkSession.createDataFrame([], NEAR)
    least = Window.partitionBy("vec").orderBy("item_id")
    rows = rows.select("item_id", "vec", "cell").withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k).drop("n")
    held = packed(ranged(rows, "item_id", int(cells.rows.sum())) if earlier else rows.sortWithinPartitions("cell"), "item_id", ["cell"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, open_ = None, None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(best.found(), preserve_index=False)

        for batch in batches:
            part = lambda name, i, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: E731, B023
            for i in range(batch.num_rows):
                if batch.column("a_ids")[i].is_valid:
                    if best is not None:
                        yield found()
                    own = part("a_ids", i, np.int64).copy()
                    q = part("a_vecs", i, np.float64).reshape(len(own), -1).copy()
                    best = Best(own, q, k, True, 12, turns=own if earlier else None, floor=threshold)
                    open_ = np.concatenate([~(cells.bounds(q[at : at + 1024]) < threshold - SINGLE_SLACK) for at in range(0, len(q), 1024)])
                ids, cell = part("b_ids", i, np.int64), part("b_cell", i, np.int64)
                if earlier and ids.min() >= best.ids.max():
                    continue
                v, turns = part("b_vecs", i, np.float64).reshape(len(ids), -1), ids if earlier else None
                names, n = np.unique(cell, return_counts=True)
                share = open_[:, names].mean(axis=0)
                if share @ n > 0.5 * len(ids):
                    best.meet(ids, v, turns=turns)
                    continue
                for c in names[share > 0]:
                    at = np.flatnonzero(cell == c)
                    best.meet(ids[at], v[at], turns=ids[at] if earlier else None, some=np.flatnonzero(open_[:, c]))
        if best is not None:
            yield found()

    return met(asked, held, (), ["cell"]).mapInArrow(work, NEAR).withColumn("similarity", F.round("similarity", 12))


def ranged(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` in the order of ``key``, so that blocks of them hold stretches of it."""
    return rows.repartitionByRange(max(1, n // (4 * BLOCK_ROWS)), key).sortWithinPartitions(key)


def check_then_index(arrivals: DataFrame, index: GrowingIndex, out_path: str, checkpoint: str, threshold: float = 0.86, k: int = 5) -> StreamingQuery:
    """For each micro-batch of arrivals (item_id, sku_id, vec): (query_id, is_duplicate, similarity, n_hits, folders) against the index as it stood and
    against those of the batch with a smaller item_id, then the batch joins the index. ``folders`` is how many folders were live."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with temporary(spark):
            rows = stored(batch.select("item_id", "sku_id", "vec"), "arrivals")
            live = index.live(spark, number - 1)
            queries = rows.select(F.col("item_id").alias("query_id"), "vec")
            asked = packed(ranged(queries, "query_id", rows.count()), "query_id")
            found = index.near(asked, index.rows(spark, live), live, threshold, k).unionByName(index.within(asked, rows.select("item_id", "vec"), threshold, k))
            hits = found.groupBy("query_id").agg(F.max("similarity").alias("similarity"), F.least(F.count("*"), F.lit(k)).alias("n_hits"))
            out = queries.select("query_id").join(hits, "query_id", "left")
            out = out.select("query_id", F.col("n_hits").isNotNull().alias("is_duplicate"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"))
            folders = len({(a, b) for a, b in zip(live["level"], live["batch"])})
            out.withColumn("folders", F.lit(folders)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
            index.add(rows, number)

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
