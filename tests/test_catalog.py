"""Invariants of catalog files, splits, pairs and text functions on small inputs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lapwing.functions import text as T
from lapwing.operators import catalog, pairs
from lapwing.sources import files

MANIFEST = [("S1", "a1", "t", "b", "A"), ("S1", "a2", "t", "b", "A"), ("S1", "a3", "t", "b", "A"), ("S2", "b1", "t", "b", "A"), ("S2", "b2", "t", "b", "A"), ("S3", "c1", "t", "b", "A"), ("S4", "d1", "t", "b", "B"), ("S4", "d2", "t", "b", "B"), ("S5", "e1", "t", "b", "B"), ("S5", "e2", "t", "b", "B"), ("S6", "f1", "t", "b", "C"), ("S6", "f2", "t", "b", "C")]


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame(MANIFEST, "sku_id string, image_path string, title string, brand string, category string")


def test_listing_files(spark, tmp_path):
    tag = lambda lang, v: {"language_tag": lang, "value": v}
    rows = [
        {"item_id": "1", "item_name": [tag("de_DE", "eins"), tag("en_US", " one ")], "brand": "B", "product_type": [tag("en_US", "SHOE")], "main_image_id": "m1", "other_image_id": ["x1", "m1", "x1"]},
        {"item_name": "no id", "main_image_id": "m1"},
        {"item_id": "2", "item_name": [tag("fr_FR", "deux")], "product_type": "", "main_image_id": "gone", "other_image_id": "x2"},
        {"item_id": "3", "item_name": {"value": "three"}, "main_image_id": "gone"},
        {"item_id": "1", "item_name": "again", "main_image_id": "x2"},
    ]
    with gzip.open(tmp_path / "listings_0.json.gz", "wt") as f:
        f.write("\n\n".join(json.dumps(r) for r in rows) + "\n{broken\n")
    (tmp_path / "images_meta.json").write_text(json.dumps(rows[0]))
    (tmp_path / "images.csv").write_text("image_id,path\nm1,a/m1.jpg\nx1,a/x1.jpg\nx2,a/x2.jpg\n,none\nx9,\n")
    listings = files.read_listings(spark, str(tmp_path))
    assert listings.count() == 5
    got = catalog.build_manifest(listings, files.read_image_index(spark, str(tmp_path), "/base")).collect()
    seen = sorted((r.sku_id, r.image_path, r.image_index, r.is_main_image, r.title, r.category) for r in got)
    assert seen == [
        ("1", "/base/a/m1.jpg", 0, True, "one", "SHOE"), ("1", "/base/a/x1.jpg", 1, False, "one", "SHOE"),
        ("1", "/base/a/x2.jpg", 0, True, "again", "OTHER"), ("2", "/base/a/x2.jpg", 0, True, "deux", "OTHER"),
    ]


def test_splits_are_disjoint(spark, manifest):
    split = catalog.split_skus(catalog.sku_table(manifest), 0.5, 0.25, 0.25)
    assert split.count() == 6
    catalog.assert_disjoint(split)
    one = spark.createDataFrame([(f"S{i}", "ONLY", 1) for i in range(10)], "sku_id string, category string, n_rows long")
    sizes = {r["split"]: r["count"] for r in catalog.split_skus(one, 0.6, 0.2, 0.2).groupBy("split").count().collect()}
    assert sizes == {"train": 6, "val": 2, "test": 2}
    with pytest.raises(ValueError):
        catalog.split_skus(one, 0.6, 0.2, 0.3)


def test_pairs(spark, manifest):
    for r in pairs.positive_pairs(manifest).collect():
        assert (r.anchor_path != r.positive_path) == r.is_multi_angle == (r.sku_id != "S3")
    negatives = {r.sku_id: r for r in pairs.hard_negatives(catalog.sku_table(manifest)).collect()}
    assert len(negatives) == 6 and all(k != r.negative_sku for k, r in negatives.items())
    assert [k for k, r in negatives.items() if not r.same_category] == ["S6"]
    with pytest.raises(ValueError):
        pairs.triplets(manifest.limit(0))
    assert pairs.draw_batch(pairs.positive_pairs(manifest).limit(0), 5).count() == 0


def test_text(spark):
    rows = [(1, "one two three four five six seven eight nine ten", "one"), (2, "word", None), (3, "", "x"), (4, None, None), (5, "Apple iPhone 15 Pro Max 256GB", "Apple")]
    df = spark.createDataFrame(rows, "k long, t string, b string")
    q = {r.k: r.q for r in df.select("k", T.text_quality(F.col("t")).alias("q")).collect()}
    assert q[1] == 0.5 and q[2] == 0.05 and q[3] == 0 and q[4] == 0
    for seed in range(2):
        for r in T.perturb(df, "t", "b", "k", seed).join(df.select("k", F.col("t").alias("was")), "k").collect():
            assert len((r.t or "").split()) <= len((r.was or "").split())
    same = T.perturb(df, "t", "b", "k", 1, 0, 0, 0, 0, 0).join(df.select("k", F.col("t").alias("was")), "k").filter("t <> was").count()
    assert same == 0


def test_listing_ids_do_not_depend_on_the_split(spark, tmp_path):
    lines = [json.dumps({"item_id": str(i % 5), "item_name": f"name {i % 7}" * 20}) for i in range(300)]
    (tmp_path / "listings_a.json").write_text("\n".join(lines))
    ids = []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = files.read_listings(spark, str(tmp_path)).select("listing_id", "item_id").collect()
        ids.append(sorted(map(tuple, got)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len({i for i, _ in ids[0]}) == 300


def test_manifest_files(spark, manifest, tmp_path):
    rows = manifest.selectExpr("sku_id", "image_path", "0 AS image_index", "true AS is_main_image", "title", "brand", "category", "if(sku_id < 'S3', 'train', 'val') AS split")
    rows = rows.withColumn("title", F.when(F.col("sku_id") == "S1", "").otherwise(F.col("title")))
    files.write_manifest(rows, str(tmp_path / "csv"), "csv")
    files.write_manifest(rows, str(tmp_path / "parquet"))
    want = sorted(map(tuple, rows.collect()))
    columns = [c.split()[0] for c in files.MANIFEST.split(", ")]
    assert sorted(map(tuple, files.read_manifest(spark, str(tmp_path / "csv")).select(columns).collect())) == want  # a missing title is an empty one
    assert sorted(map(tuple, spark.read.schema(files.MANIFEST).parquet(str(tmp_path / "parquet")).select(columns).collect())) == want
    plan = spark.read.parquet(str(tmp_path / "parquet")).filter("split = 'val'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_rows_on_disk(spark, manifest, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a1", "c1"):
        (tmp_path / "deep" / name).write_bytes(b"x")
    rows = manifest.withColumn("image_path", F.concat(F.lit(f"{tmp_path}/deep/"), "image_path"))
    assert sorted(r.image_path[-2:] for r in files.on_disk(rows, str(tmp_path)).collect()) == ["a1", "c1"]


def test_parameters_thresholds_and_appends(spark, tmp_path):
    import numpy as np

    weights = {"w": np.arange(6.0).reshape(2, 3), "b": np.array([0.1]), "one": np.array(2.5)}
    files.write_parameters(spark, weights, [("epoch", "3"), ("note", "")], str(tmp_path / "p"))
    got, metadata = files.read_parameters(spark, str(tmp_path / "p"))
    assert metadata == {"epoch": "3", "note": ""} and set(got) == set(weights) and all((got[k] == weights[k]).all() and got[k].shape == weights[k].shape for k in weights)
    rows = spark.createDataFrame([("A", 0.5, 1), ("__default__", 0.123456789012, 2)], "category string, threshold double, n int")
    files.write_thresholds(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_thresholds(spark, str(tmp_path / "t")).collect())) == [("A", 0.5), ("__default__", 0.123456789012)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_thresholds(spark, str(tmp_path / "nowhere")).collect()
    for n in range(2):
        files.append_items(spark.createDataFrame([(n, [1.0])], "item_id long, vec array<double>"), str(tmp_path / "i"))
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "i")).collect()) == [0, 1]
    assert [json.loads(r.value) for r in files.event_log(spark.createDataFrame([(1, None, "x")], "a int, b int, c string")).collect()] == [{"a": 1, "c": "x"}]


def test_sketches_merge(spark):
    rows = spark.range(3000).selectExpr("id % 500 AS sku_id", "if(id % 2 = 0, 'a', 'b') AS category")
    sketches = catalog.category_sketches(rows)
    every = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).first()[0]
    assert abs(every - 500) <= 25 and {r.category for r in sketches.collect()} == {"a", "b"}


def test_last_value_of_a_key(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2), ("b", None, 1)], "k string, v string, n int")
    assert {r.k: r.v for r in catalog.last_of(rows, "k", "v", "n").collect()} == {"a": "y", "b": None}
