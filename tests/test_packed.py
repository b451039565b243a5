"""Exact search by packed blocks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.operators import blocks


def brute(q, v, k, valid, digits=12):
    near = np.round(q @ v.T, digits) if digits else q @ v.T
    order = [np.lexsort((np.arange(len(v)), -np.where(ok, row, -np.inf))) for row, ok in zip(near, valid)]
    return [[int(j) for j in o[:k] if ok[j]] for o, ok in zip(order, valid)]


@pytest.mark.parametrize("scale", [1.0, 1e-13, 1e30])
def test_best_meets_blocks(scale, monkeypatch):
    monkeypatch.setattr(blocks.Best, "WIDTH", 50, raising=False)
    monkeypatch.setattr(blocks.Best, "TILE", 2000, raising=False)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 12)) * np.sqrt(scale)
    v[40:90] = v[40]  # copies
    v[99] = 0
    ids, sku, digits = np.arange(300), np.arange(300) % 30, 12 if scale == 1 else 0
    own = ids[None, :] == ids[:, None]
    cases = {"plain": ({}, np.ones_like(own)), "self": ({"drop_self": True}, ~own), "sku": ({"skus": sku}, sku[:, None] != sku[None, :]), "turn": ({"turns": ids}, ids[None, :] < ids[:, None])}
    for k in (1, 7, 400):
        for name, (how, valid) in cases.items():
            best = blocks.Best(ids, v, k, how.get("drop_self", False), digits, how.get("skus"), how.get("turns"))
            for some in np.array_split(rng.permutation(300), 4):
                best.meet(some, v[some], sku[some], some)
            found = best.found()
            got = [found["item_id"].to_numpy()[found["query_id"].to_numpy() == i].tolist() for i in ids]
            if digits:
                assert got == brute(v, v, k, valid), (k, name)
            else:  # products are no longer rounded, so copies may come in any order
                want = brute(v, v, k, valid, 0)
                score = v @ v.T
                assert all(np.allclose(score[i, a], score[i, b], rtol=1e-12, atol=0) for i, (a, b) in enumerate(zip(got, want))), (k, name)


def test_floor_and_places():
    x = np.eye(4)[[0, 0, 1, 2]] + 0.25
    best = blocks.Best(np.arange(4), x, 3, False, 12, floor=float(round(x[0] @ x[0], 12)))
    best.meet(np.arange(4), x, some=np.array([0, 3]))
    assert best.found()[["query_id", "item_id"]].to_numpy().tolist() == [[0, 0], [0, 1], [3, 3]]


def test_large_query_sets_meet_in_a_product_without_copies(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SENT_BYTES", 4000)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40, raising=False)
    x = np.random.default_rng(8).normal(size=(130, 16))
    x[3:9] = x[3]
    items = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "item_id long, vec array<double>").repartition(3)
    queries = items.select(F.col("item_id").alias("query_id"), "vec")
    want = brute(x, x, 4, ~np.eye(130, dtype=bool))
    for same in (True, False):
        out = blocks.top_k(queries, items, 4, same=same)
        plan = out._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "FlatMapCoGroupsInPandas" not in plan  # no block is shuffled once for each that it meets
        got = {(r.query_id, r["rank"]): r.item_id for r in out.collect()}
        assert got == {(i, n + 1): j for i, row in enumerate(want) for n, j in enumerate(row)}
    twice = blocks.top_k(queries.union(queries.limit(5)), items, 4)
    assert twice.groupBy("query_id").count().filter("count <> 4").isEmpty()  # a query that comes twice keeps one ranking


def test_samples_reach_the_driver_from_one_partition(spark):
    from lapwing.sources.shared import least_hashes

    rows = spark.range(20_000, numPartitions=40).select(F.col("id").alias("item_id"), (F.col("id") % 7).alias("x"))
    got = least_hashes(rows, "item_id", 50, "x")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in rows.orderBy(F.xxhash64("item_id"), "item_id", "x").limit(50).collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(1)" in plan or "SinglePartition" in plan  # not the 50 best of each of 40 partitions
    one = rows.select(F.lit(3).cast("long").alias("item_id"), "x")
    assert least_hashes(one, "item_id", 50, "x").count() == 50 and least_hashes(rows.limit(3), "item_id", 50).count() == 3


def test_sql_search_moves_no_copies(spark, data):
    from lapwing.plans import search_queries

    out = search_queries.sql_nearest(spark, data)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, search_queries.exact_topk(spark, data).collect()))
    assert "CartesianProduct" in out._jdf.queryExecution().toString()  # rows were dealt to every block before


def test_mining_is_fed_in_bounded_files(spark, data, monkeypatch):
    from lapwing.plans import search_queries

    fed = []
    whole = search_queries._fed
    monkeypatch.setattr(search_queries, "FED_ROWS", 150, raising=False)
    monkeypatch.setattr(search_queries, "_fed", lambda *a, **k: fed.append(whole(*a, **k)) or fed[-1])
    got = search_queries.stream_mining(spark, data)
    sizes = [r["count"] for r in spark.read.parquet(f"{fed[0]}/in").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 7 and sum(sizes) == 1000 and max(sizes) <= 150  # four files before, of any size
    assert not got.isEmpty()


def test_mining_has_few_state_partitions_and_files_without_vectors(spark, data, monkeypatch):
    import os

    from lapwing.plans import search_queries

    fed = []
    whole = search_queries._fed
    monkeypatch.setattr(search_queries, "_fed", lambda *a, **k: fed.append(whole(*a, **k)) or fed[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        want = search_queries.stream_mining(spark, data).count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    folder = fed[0].removeprefix("file://").replace("file:", "")
    assert len([x for x in os.listdir(f"{folder}/log/state/0") if x.isdigit()]) == 16  # one for each of any number of shuffle partitions before
    assert "vec" not in spark.read.parquet(f"{fed[0]}/in").columns and want > 0


def test_arrivals_are_packed_as_they_are():
    import pyarrow as pa

    from lapwing.streaming.mining import pack_arrivals

    v = [[0.5, 1.0], [0.25, 2.0], [1 / 3, 0.0]]
    batch = lambda some: pa.RecordBatch.from_pydict({"bank": ["a", None, "a"][: len(some)], "seq": [3, 1, 2][: len(some)], "sku_id": [7, 8, 9][: len(some)], "vec": pa.array(some, pa.list_(pa.float64()))})
    for some, single in ((v, False), (v[:2], True)):
        (out,) = pack_arrivals([batch(some), batch([])])
        got = {}
        for r in out.to_pylist():
            assert r["single"] == single
            x = np.frombuffer(r["vecs"], np.float32 if single else np.float64).reshape(-1, 2)
            got |= {(r["bank"], int(a), int(b)): c.tolist() for a, b, c in zip(np.frombuffer(r["seqs"], np.int64), np.frombuffer(r["skus"], np.int64), x)}
        assert got == {(b, s, k): x for b, s, k, x in zip(["a", None, "a"], [3, 1, 2], [7, 8, 9], some)}


def test_sql_topk_moves_packed_blocks(spark, data, monkeypatch):
    from lapwing.plans import search_queries

    monkeypatch.setattr(blocks, "_block_rows", lambda n: 60)
    out = search_queries.sql_topk(spark, data)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, search_queries.exact_topk(spark, data).collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "a_block" in plan and "Window" not in plan  # every two blocks met twice and gave their rows one by one to a window


@pytest.mark.parametrize("sent", [blocks.SENT_BYTES, 4000])
def test_sweep_takes_each_product_once(spark, monkeypatch, sent):
    from lapwing.operators import search

    monkeypatch.setattr(blocks, "SENT_BYTES", sent)
    x = np.random.default_rng(21).normal(size=(300, 9))
    x[40:75] = x[40]  # more ties than places
    items = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "item_id long, vec array<double>").repartition(3)
    queries = items.select(F.col("item_id").alias("query_id"), "vec")
    centroids, grid, k = x[:12], [1, 3, 12], 6
    found = search.probed_top_k(queries, search.assign(items, centroids), centroids, None, grid, k).select("nprobe", "query_id", "item_id")
    truth = blocks.top_k(queries, items, k, drop_self=False).select("query_id", "item_id")
    want = {r.nprobe: r.n for r in found.join(truth, ["query_id", "item_id"]).groupBy("nprobe").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(search, "probed_top_k", None)  # the cells were searched beside all items before
    got = {r.nprobe: r.recall for r in search.sweep(queries, items, 12, k, [*grid, 40], centroids, same=True).collect()}
    assert got == {p: pytest.approx(want[p] / 1800) for p in grid} and got[1] < got[3] < got[12] == 1.0


@pytest.mark.parametrize("thresholds", [[0.5, 0.2], [0.0], [-3.0], [50.0]])
def test_counts_of_all_pairs_move_no_copies(spark, monkeypatch, thresholds):
    from lapwing.operators import threshold

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(threshold, "WORTHWHILE", -1.0, raising=False)
    x = np.random.default_rng(9).normal(size=(190, 10)) / 3
    x[3:29] = x[3]
    x[29:31] *= 4
    x[31] = 0
    sku = np.arange(190) // 4
    sku[5:20] = 1
    items = spark.createDataFrame([(i, int(s), [float(c) for c in r]) for i, (s, r) in enumerate(zip(sku, x))], "item_id long, sku_id long, vec array<double>").repartition(5)
    out = threshold.threshold_counts(items, thresholds)
    near, same = x @ x.T, sku[:, None] == sku[None, :]
    pair = np.triu(np.ones_like(same), 1)
    for r in out.collect():
        hit = near >= r.threshold
        assert (r.tp, r.fp, r.fn) == ((hit & same & pair).sum(), (hit & ~same & pair).sum(), (~hit & same & pair).sum()), r.threshold
    assert "CartesianProduct" in out._jdf.queryExecution().toString()  # rows were copied to each block that they meet


@pytest.mark.parametrize("mates", [False, True])
@pytest.mark.parametrize("drop_self", [False, True])
def test_blocks_of_one_table_meet_once(spark, monkeypatch, drop_self, mates):
    monkeypatch.setattr(blocks, "SENT_BYTES", 4000)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(blocks, "_block_rows", lambda n: 40, raising=False)
    monkeypatch.setattr(blocks, "FLOOR_ROWS", 30, raising=False)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(330, 12))
    x[3:90] = x[3]  # copies in several blocks
    x[100] *= 50
    x[101] = 0
    sku = np.where(np.arange(330) < 40, 0, np.arange(330) // 3)
    sku[320:] = np.arange(320, 330) + 1000
    items = spark.createDataFrame([(i, int(s), [float(c) for c in r]) for i, (s, r) in enumerate(zip(sku, x))], "item_id long, sku_id long, vec array<double>").repartition(4)
    out = blocks.top_k(items.select(F.col("item_id").alias("query_id"), "vec"), items, 6, drop_self=drop_self, same=True, mates=mates)
    assert "a_block" in out._jdf.queryExecution().toString()  # each block met all others, and each product was taken twice
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.item_id)
        assert len(got[r.query_id]) == r["rank"]
    want = brute(x, x, 6, ~np.eye(330, dtype=bool) if drop_self else np.ones((330, 330), bool))
    for i, row in enumerate(want):
        if not mates:
            assert got[i] == row
        else:  # whole down to the last match
            hit = [n for n, j in enumerate(row) if sku[j] == sku[i] and j != i]
            upto = hit[-1] + 1 if hit else 0
            assert got.get(i, [])[:upto] == row[:upto], i


def test_precision_without_what_lies_under_the_matches(spark, monkeypatch):
    from lapwing.operators import evaluate

    x = np.random.default_rng(12).normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sku = np.where(np.arange(400) < 30, 0, np.arange(400) // 3)
    sku[390:] = np.arange(390, 400) + 1000
    x[200:300] = x[sku[200:300] * 2] + 0.1 * x[200:300]
    items = spark.createDataFrame([(i, int(s), [float(c) for c in r]) for i, (s, r) in enumerate(zip(sku, x))], "item_id long, sku_id long, vec array<double>").repartition(4)
    rows = lambda: sorted((r.k, r.n_queries, round(r.precision, 9), round(r.recall, 9)) for r in evaluate.precision_recall(items, (1, 3, 7)).collect())
    want = rows()
    monkeypatch.setattr(blocks, "SENT_BYTES", 4000)
    monkeypatch.setattr(blocks, "_block_rows", lambda n: 50, raising=False)
    assert rows() == want and want[0][1] == 390 and 0 < want[0][2] < 1


def test_floors_are_under_the_last_kept():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(700, 16)) * rng.uniform(0.1, 30, size=(700, 1))
    for rows, k in ((600, 5), (300, 5), (520, 300), (4, 5), (6, 5)):
        low = blocks.sample_floors(np.arange(rows), x[:rows], k, True, 12)(np.arange(700), x)
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        kth = np.sort(near, axis=1)[:, -k]
        assert (low <= kth).all() and (np.isfinite(low).all() if rows > k + 1 else True)


def clusters_and_noise() -> np.ndarray:
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 24))
    x[100:200] = x[rng.integers(0, 12, 100)] + 0.4 * rng.normal(size=(100, 24))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_any_hit_keeps_only_hits_in_tasks(spark, monkeypatch):
    from lapwing.operators import bounded, serve

    x = clusters_and_noise()
    items = spark.createDataFrame([(i, i // 2, [float(c) for c in r]) for i, r in enumerate(x)], "item_id long, sku_id long, vec array<double>").repartition(4)
    queries = items.select(F.col("item_id").alias("query_id"), "vec")
    near = np.round(x @ x.T, 12)
    np.fill_diagonal(near, -1)
    found = []
    whole = bounded.top_k
    monkeypatch.setattr(bounded, "top_k", lambda *a, **b: found.append(whole(*a, **b)) or found[-1])
    for sent in (blocks.SENT_BYTES, 4000):
        monkeypatch.setattr(blocks, "SENT_BYTES", sent)
        monkeypatch.setattr(blocks, "_block_rows", lambda n: 40, raising=False)
        for threshold in (0.6, 0.0):
            got = {r.query_id: (r.is_duplicate, round(r.similarity, 9), r.n_hits) for r in serve.check_any(queries, items, threshold, same=True).collect()}
            for i, row in enumerate(np.clip(near, 0, 1)):
                hits = np.sort(row[np.arange(300) != i])[::-1][:5]
                hits = hits[hits >= threshold]
                assert got[i] == (len(hits) > 0, round(float(hits.max()), 9) if len(hits) else 0.0, len(hits)), (i, threshold)
    assert found[-2].count() < found[-1].count() == 1500  # what is under .6 was carried to the end before


def test_tags_take_the_vectors_of_one_sample(spark, monkeypatch):
    from lapwing.operators import bounded, serve

    x = clusters_and_noise()
    items = spark.createDataFrame([(i, i // 2, [float(c) for c in r]) for i, r in enumerate(x)], "item_id long, sku_id long, vec array<double>").repartition(4)
    monkeypatch.setattr(blocks, "SENT_BYTES", 4000)
    monkeypatch.setattr(blocks, "_block_rows", lambda n: 40, raising=False)
    samples, sample_of = [], bounded.sample_of
    monkeypatch.setattr(bounded, "sample_of", lambda *a: samples.append(a[1]) or sample_of(*a))
    out = serve.tagged(serve.candidates(items.select(F.col("item_id").alias("query_id"), "vec"), items, 3, same=True), 0.7).collect()
    want = brute(x, x, 3, ~np.eye(300, dtype=bool))
    assert {(r.query_id, r["rank"]): (r.item_id, r.is_match) for r in out} == {(i, n + 1): (j, bool(np.round(x[i] @ x[j], 12) >= 0.7)) for i, row in enumerate(want) for n, j in enumerate(row)}
    assert samples == ["item_id"]  # the items were sampled once more, as queries


def test_samples_of_rows_without_vectors_and_of_one_key(spark):
    from lapwing.operators.cells import sample_of
    from lapwing.sources.shared import least_hashes

    rows = spark.range(3000, numPartitions=5).select(F.col("id").alias("item_id"), F.when(F.col("id") % 5 > 2, F.array(F.col("id").cast("double"))).alias("vec"))
    for some, most in ((rows, 100), (rows, 1100), (rows.filter("vec is not null"), 40), (rows.filter("vec is not null").withColumn("item_id", F.lit(7).cast("long")), 30), (rows.filter("false"), 10)):
        ids, v = sample_of(some, "item_id", most)
        want = [r.item_id for r in least_hashes(some.filter("vec is not null").select("item_id", "vec"), "item_id", most).collect()]
        assert ids.tolist() == want and len(v) == len(want)
