"""The index on disk, the growing index, and its compaction."""

import numpy as np
from pyspark.sql import functions as F

from lapwing.operators import blocks, search
from lapwing.sources import index
from tests.test_search import clustered, frame


def test_stored_index_is_read_by_cell(spark, tmp_path):
    items = frame(spark, clustered(12, 30, 32, 0.2))
    queries = items.filter("item_id < 25").select(F.col("item_id").alias("query_id"), "vec")
    centroids = search.kmeans_centroids(items, 12)
    cells = search.assign(items, centroids)
    codes, book = search.pq_index(cells, centroids, 8, 5)
    index.write_index(str(tmp_path / "whole"), centroids, cells)
    index.write_index(str(tmp_path / "coded"), centroids, codes, book)
    other = spark.newSession()
    asked = other.createDataFrame(queries.collect(), queries.schema)
    for name, want in (("whole", search.ivf_search(queries, cells, centroids, 3, 4)), ("coded", search.pq_search(queries, codes, centroids, book, 3, 4))):
        kept = index.read_index(other, str(tmp_path / name))
        got = sorted(map(tuple, index.search_index(asked, kept, 3, 4).collect()))
        assert got == sorted(map(tuple, want.collect())) and len(got) == 100
        rows = index.probed_rows(kept, asked, 1)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan
        few = {r.cell for r in search.probed(asked, centroids, 1).select("cell").distinct().collect()}
        assert {r.cell for r in rows.select("cell").distinct().collect()} == few and len(few) < 12


def test_visits_in_sets_and_parts(spark):
    x = np.random.default_rng(2).normal(size=(200, 16))
    items = frame(spark, x / np.linalg.norm(x, axis=1)[:, None])
    queries = items.select(F.col("item_id").alias("query_id"), "vec")
    centroids = search.first_centroids(items, 5)
    cells = search.assign(items, centroids)
    work = search._whole(6)
    near = search._by_cell(search.probed(queries, centroids, 5), cells, work, part_rows=17, n_queries=200, query_rows=23)
    exact = blocks.top_k(queries, items, 6, drop_self=False)
    assert sorted(map(tuple, search._ranked(near, 6).collect())) == sorted(map(tuple, exact.collect()))


def test_growing_index_merges_batches(spark, tmp_path):
    from lapwing.operators.cells import sampled_centres
    from lapwing.streaming.growing import GrowingIndex, check_then_index

    x = clustered(10, 24, 16, 0.15)
    x[30:44] = x[30]  # copies within a batch and across batches
    items = frame(spark, x[np.random.default_rng(0).permutation(len(x))])
    n = 12
    index = GrowingIndex.create(spark, str(tmp_path / "index"), sampled_centres(items), fan=3)
    for b in range(n):
        items.filter(F.floor(F.col("item_id") * n / 240) == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if b == n // 2 - 1 or b == n - 1:  # a query that ends and one that goes on from its checkpoint
            stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            check_then_index(stream, GrowingIndex.open(spark, index.path, 3), str(tmp_path / "out"), str(tmp_path / "log"), 0.8).awaitTermination()
    got = {r.query_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    v = np.array([r.vec for r in items.orderBy("item_id").collect()])
    near = np.round(v @ v.T, 12)
    for i in range(240):
        before = near[i, :i][near[i, :i] >= 0.8]
        assert (got[i].is_duplicate, got[i].n_hits) == (len(before) > 0, min(5, len(before)))
        assert got[i].similarity == (before.max() if len(before) else 0.0)
    assert max(r.folders for r in got.values()) <= 5  # twelve batches, two folders a level at most after a merge, and the newest
    live = index.live(spark, n - 1)
    assert index.rows(spark, live).count() == 240 and live["n"].sum() == 240
    import os

    assert len([d for level in os.listdir(tmp_path / "index" / "rows") for d in os.listdir(tmp_path / "index" / "rows" / level) if d.startswith("batch")]) <= 9


def test_growing_index_copies_no_vectors_for_cells(spark, tmp_path, monkeypatch):
    from lapwing.operators.cells import sampled_centres
    from lapwing.sources import shared
    from lapwing.streaming import growing

    x = clustered(10, 24, 16, 0.15)
    x[30:60] = x[30]
    x = x[np.random.default_rng(1).permutation(len(x))]
    items = frame(spark, x).select("item_id", "sku_id", "vec")
    index = growing.GrowingIndex.create(spark, str(tmp_path / "index"), sampled_centres(items))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    stored = []
    with shared.temporary(spark):
        new = items.filter("item_id >= 120")
        live = index.add(items.filter("item_id < 120"), 0)
        asked = blocks.packed(growing.ranged(new.withColumnRenamed("item_id", "query_id"), "query_id", 120), "query_id")
        stored += [p for _, p in shared._STORED[-1:]]
        near = np.round(x @ x.T, 12)
        for threshold in (0.8, -2.0):  # some cells are open, and all
            old, own = index.near(asked, index.rows(spark, live), live, threshold, 4), index.within(asked, new.select("item_id", "vec"), threshold, 4)
            for found, first in ((old, 0), (own, 120)):
                plan = found._jdf.queryExecution().toString()
                assert "CartesianProduct" in plan and "CoGroup" not in plan  # each part of a cell was copied for each set of its queries
                got = {}
                for r in found.collect():
                    got.setdefault(r.query_id, []).append(r.similarity)
                for i in range(120, 240):
                    want = sorted((s for s in near[i, first : 120 if not first else i] if s >= threshold), reverse=True)
                    have = sorted(got.get(i, []), reverse=True)
                    assert have[:1] == want[:1] and min(4, len(have)) == min(4, len(want))
        assert spark.read.parquet(stored[0]).count() > 0
    import os

    assert not os.path.exists(stored[0].removeprefix("file://"))  # tables of a micro-batch stayed until the session's end
