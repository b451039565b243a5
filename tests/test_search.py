"""Invariants of search, metrics, calibration, losses, images and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.functions import images
from lapwing.operators import blocks, bounded, calibrate, components, evaluate, fusion, search, serve, threshold
from lapwing.plans import search_queries

SCHEMA = "item_id long, sku_id long, vec array<double>"


def frame(spark, x, skus=None):
    return spark.createDataFrame([(i, int(i if skus is None else skus[i]), [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


@pytest.fixture(scope="module")
def unit():
    x = np.random.default_rng(42).normal(size=(300, 32))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_index(spark, unit):
    items = frame(spark, unit)
    queries = items.filter("item_id < 20").select(F.col("item_id").alias("query_id"), "vec")
    p = search.adapt(300, 32, 16, 30)
    assert (p.nlist, p.m, p.nbits) == (16, 16, 8)
    centroids = search.kmeans_centroids(items, p.nlist)
    cells = search.assign(items, centroids)
    codes, book = search.pq_index(cells, centroids, 16, 6)
    flat = blocks.top_k(queries, items, 5, drop_self=False)
    assert all(r.item_id == r.query_id for r in flat.filter("rank = 1").collect())
    pq = search.pq_search(queries, codes, centroids, book, 16, 5)
    assert sum(r.item_id == r.query_id for r in pq.filter("rank = 1").collect()) >= 16
    full = search.ivf_search(queries, cells, centroids, 16, 5)
    assert search.recall(full, flat, 5).first().recall == 1


def test_grid_equals_scan(spark, unit, monkeypatch):
    items = frame(spark, unit[:90])
    queries = items.select(F.col("item_id").alias("query_id"), "vec")
    scan = sorted(map(tuple, blocks.top_k(queries, items, 4).collect()))
    monkeypatch.setattr(blocks, "SENT_BYTES", 4000)
    assert sorted(map(tuple, blocks.top_k(queries, items, 4).collect())) == scan


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(6)
    x = np.zeros((40, 6))
    x[:7, 0] = 1  # two groups of copies at similarity .9, which fill each other's nearest
    x[7:14, :2] = 0.9, np.sqrt(1 - 0.81)
    x[14:18, 2] = 0.5  # copies with a product under the threshold, alone
    x[18:22, 3], x[22, 3] = 0.5, 1.2  # such copies, and an item that joins them
    x[23:] = rng.normal(size=(17, 6)) * 0.4
    order = rng.permutation(40)
    items = frame(spark, x[order])
    y = x[order]
    root = list(range(40))
    for a in range(40):
        for b in range(a):
            if round(float(y[a] @ y[b]), 12) >= 0.5:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    for rows in (1024, 5):
        links = threshold.threshold_links(items, 0.5, block_rows=rows)
        got = {r.node: r.cluster for r in components.clusters(links, items.select(F.col("item_id").alias("node"))).collect()}
        assert got == dict(enumerate(root))


def clustered(n_centres: int, each: int, dim: int, spread: float, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n_centres, dim)), each, axis=0) + rng.normal(size=(n_centres * each, dim)) * spread
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_threshold_join_compares_few_pairs(spark):
    x = clustered(40, 50, 64, 0.15)
    x[7] *= 3  # a long vector, a zero vector and copies
    x[9] = 0
    x[100:130] = x[100]
    skus = np.arange(len(x)) % 300
    items = frame(spark, x, skus).repartition(4)
    near = np.round(x @ x.T, 12)[np.triu_indices(len(x), 1)]
    same = (skus[:, None] == skus[None, :])[np.triu_indices(len(x), 1)]
    for rows in (16_384, 600):
        for r in threshold.threshold_counts(items, [0.6, 0.9], block_rows=rows).collect():
            hit = near >= r.threshold
            assert (r.tp, r.fp, r.fn) == ((hit & same).sum(), (hit & ~same).sum(), (~hit & same).sum())
            assert r.compared < 0.1 * len(near)
        pairs = threshold.threshold_pairs(items, 0.9, block_rows=rows).toPandas()
        assert len(pairs) == (near >= 0.9).sum() == len(pairs.drop_duplicates(["a", "b"])) and (pairs["a"] < pairs["b"]).all()


def test_threshold_join_without_structure(spark):
    x = np.random.default_rng(3).normal(size=(150, 8))
    items, near = frame(spark, x, np.arange(150) // 2), np.round(x @ x.T, 12)[np.triu_indices(150, 1)]
    for t in (-0.5, 0.0, 2.0):  # a threshold that all but opposite vectors reach rules nothing out
        r = threshold.threshold_counts(items, [t], block_rows=40).first()
        assert r.tp + r.fp == (near >= t).sum() and r.tp + r.fn == 75
    none = threshold.threshold_counts(items.filter("false"), [0.5]).first()
    assert (none.tp, none.fp, none.fn) == (0, 0, 0) and threshold.threshold_links(items.filter("false"), 0.5).isEmpty()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (539, 161)]
    links = spark.createDataFrame(chain, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [1, 7, *range(100, 162), *range(500, 540)]], "node long")
    got = {r.node: r.cluster for r in components.clusters(links, nodes).collect()}
    assert got == {1: 1, 7: 7} | dict.fromkeys(range(100, 161), 100) | dict.fromkeys([161, *range(500, 540)], 161)


def test_bounded_search_equals_exact(spark):
    x = clustered(30, 40, 64, 0.2, seed=4)
    x[5] *= 2
    x[40:60] = x[40]
    x[61] = 0
    items = frame(spark, x).repartition(3)
    queries = items.filter("item_id % 3 = 0").select(F.col("item_id").alias("query_id"), "vec")
    want = {(r.query_id, r["rank"]): (r.item_id, r.similarity) for r in blocks.top_k(queries, items, 5).collect()}
    index = bounded.cell_index(items)
    for part_rows in (20_000, 25):
        found, visits = bounded.bounded_top_k(queries, index, 5, part_rows=part_rows)
        assert {(r.query_id, r["rank"]): (r.item_id, r.similarity) for r in found.collect()} == want
        assert visits.agg(F.avg("cells")).first()[0] < 0.5 * index.cells.rows.astype(bool).sum()
        assert visits.count() == queries.count()
    assert bounded.open_share(queries, items, 5)[0] < 0.3 < bounded.open_share(*[frame(spark, np.random.default_rng(1).normal(size=(300, 64))).withColumn("query_id", F.col("item_id"))] * 2, 5)[0]
    assert {(r.query_id, r["rank"]): (r.item_id, r.similarity) for r in bounded.nearest(queries, items, 5).collect()} == want


def test_bounded_search_of_few_and_none(spark):
    items = frame(spark, np.random.default_rng(5).normal(size=(4, 6)))
    queries = items.select(F.col("item_id").alias("query_id"), "vec")
    for rows in (items, items.filter("item_id = 2"), items.filter("false")):
        index = bounded.cell_index(rows)
        want = sorted(map(tuple, blocks.top_k(queries, rows, 3).collect()))
        assert sorted(map(tuple, bounded.bounded_top_k(queries, index, 3)[0].collect())) == want
    assert bounded.bounded_top_k(queries.filter("false"), bounded.cell_index(items), 3)[0].isEmpty()


def test_clusters_of_copies(spark, monkeypatch):
    from lapwing.plans import search_queries

    items = frame(spark, [[1.0, 0.0]] * 7 + [[0.9, np.sqrt(1 - 0.81)]] * 7)
    monkeypatch.setattr(search_queries.tables, "items", lambda spark, d: items.withColumn("category", F.lit(0)))
    assert {r.cluster for r in search_queries.duplicate_clusters(spark, "").collect()} == {0}


def test_metrics(spark):
    e = np.eye(4)
    items = frame(spark, [e[0]] * 4 + [e[1]] * 4, [0] * 4 + [1] * 4)
    assert evaluate.pairwise_f1(items, [0.7]).first().f1 == 1
    r = evaluate.precision_recall(items, (3,)).first()
    assert (r.precision, r.recall) == (1, 1)
    assert evaluate.pairwise_f1(items.limit(1), [0.7]).first().f1 == 0
    losses = evaluate.info_nce(spark.createDataFrame([], "batch long, pos long, anchor array<double>, positive array<double>"))
    assert losses.count() == 0


def test_calibration(spark):
    rng = np.random.default_rng(42)
    s = np.clip(np.concatenate([rng.normal(0.88, 0.05, 200), rng.normal(0.35, 0.10, 800)]), 0, 1).round(4)
    rows = [("A", float(x), int(i < 200), 1) for i, x in enumerate(s)]
    pairs = spark.createDataFrame(rows, "category string, similarity double, label int, n long")
    for fit in (calibrate.best_thresholds, calibrate.golden_thresholds):
        got = {r.category: r.threshold for r in fit(pairs).collect()}
        assert set(got) == {"A", calibrate.DEFAULT} and 0.55 <= got["A"] <= 0.85
    assert abs(calibrate.bounded_minimum(lambda x: (x - 0.6) ** 2, 0.3, 0.99) - 0.6) < 1e-4


def test_mining_and_decisions(spark, unit):
    items = frame(spark, unit[:40], [i // 2 for i in range(40)])
    anchors = items.select(F.col("item_id").alias("query_id"), "sku_id", "vec")
    mined = evaluate.hard_negatives(anchors, items, 3).join(items.select("item_id", F.col("sku_id").alias("other")), "item_id").join(anchors.select("query_id", "sku_id"), "query_id")
    assert mined.count() == 120 and mined.filter("other = sku_id").count() == 0
    thresholds = spark.createDataFrame([("x", 0.2)], "category string, threshold double")
    requests = anchors.select("query_id", F.lit("y").alias("category"), "vec")
    for r in serve.check(requests, items, thresholds, 3).collect():
        assert r.threshold_used == 0.7 and len(r.candidates) == 3 and all(0 <= c.similarity <= 1 for c in r.candidates)
    empty = serve.check(requests.limit(1), items.limit(0), thresholds, 3).first()
    assert not empty.is_duplicate and empty.similarity == 0 and empty.candidates == []


def test_fusion():
    w = fusion.seeded_weights(8, 8, 16, 12, 6)
    rng = np.random.default_rng(1)
    x, g = fusion.forward(rng.normal(size=(5, 8)), rng.normal(size=(5, 8)), np.ones(5), np.ones(5), w)
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and np.allclose(g.sum(axis=1), 1)


def test_images():
    rng = np.random.default_rng(2)
    noisy, flat = rng.integers(0, 256, (256, 256, 3)), np.full((256, 256, 3), 90)
    assert images.quality(noisy) >= images.quality(flat) and images.quality(flat) <= 0.4
    assert images.quality(None) == images.quality(np.zeros((2, 9))) == 0.5
    assert images.augment(rng.integers(0, 256, (30, 20, 3)), 3, 64).shape == (64, 64, 3)
    assert images.cutout(np.zeros((100, 100)), rng).shape == (100, 100)
    assert np.abs(images.compress(noisy[:16, :16], 95) - noisy[:16, :16]).mean() < 6
    assert images.decode_base64("data:image/png;base64,aGk") == b"hi" and images.decode_base64("*") == b""


def test_recall_grows_with_probes(spark, data):
    """The compressed index against exact search: more cells, more recall, and most of it at the last."""
    rows = search_queries.pq_sweep(spark, data).orderBy("nprobe").collect()
    recalls = [r.recall for r in rows]
    assert len(rows) > 2 and recalls == sorted(recalls) and recalls[-1] >= 0.75 and all(r.n_queries == rows[0].n_queries for r in rows)


def test_ties_go_to_smaller_ids():
    import numpy as np

    from lapwing.operators.blocks import _best

    v = np.tile(np.array([[0.6, 0.8]]), (40, 1)) * (1 + 1e-15 * np.arange(40)[:, None])
    got = _best(np.array([0]), v[:1], np.arange(40), v, 5, True, digits=12)
    assert got["item_id"].tolist() == [1, 2, 3, 4, 5]
    turns = (np.array([7]), np.arange(40))
    assert _best(np.array([7]), v[7:8], np.arange(40), v, 50, True, turns=turns, digits=12)["item_id"].tolist() == list(range(7))
