"""Order statistics, bucketed tables, encoded texts and table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.functions.encode import encode_texts
from lapwing.operators import order, table_functions
from lapwing.plans import catalog_queries
from lapwing.sources.buckets import bucketed
from tests.test_search import frame


@pytest.mark.parametrize("values", [
    [3.0], [1.0] * 50, np.random.default_rng(0).normal(size=500).tolist(), [1e-300, 1e300, -1e300, 0.0, 5e-324] * 3, [1.0, 1.0 + 2e-16, 2.0, float("inf"), -float("inf")],
])
def test_order_statistics(spark, monkeypatch, values):
    monkeypatch.setattr(order, "FEW", 2)  # down to equal values
    monkeypatch.setattr(order, "RANGES", 7)
    rows = spark.createDataFrame([(x,) for x in [*values, None, float("nan")]], "x double")
    want = np.clip(sorted(values), -order.MOST, order.MOST)
    places = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
    assert order.order_statistics(rows, "x", places) == [want[p] for p in places]


def test_order_statistics_of_nothing(spark):
    assert order.order_statistics(spark.createDataFrame([(None,)], "x double"), "x", [0]) == []


def exchanges(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ")


def test_bucketed_tables_join_in_place(spark):
    rows = spark.createDataFrame([(i % 40, i, f"r{i}") for i in range(400)], "sku_id long, n long, label string")
    keys = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(0, 60, 2)], "sku_id long, split string")
    a, b = bucketed(rows, "sku_id", 4), bucketed(keys, "sku_id", 4)
    out = a.join(b.hint("merge"), "sku_id").groupBy("sku_id").agg(F.count("*").alias("n"), F.first("split").alias("split"))
    assert exchanges(out) == 0 < exchanges(rows.join(keys.hint("merge"), "sku_id").groupBy("sku_id").count())
    assert {r.sku_id: (r.n, r.split) for r in out.collect()} == {i: (10, "a" if i % 3 else "b") for i in range(0, 40, 2)}


def test_registered_bucketed_plan_moves_nothing(spark, data):
    assert exchanges(catalog_queries.bucketed_splits(spark, data)) == 0


def test_encoded_texts_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "A b  a"), (2, "a a B"), (3, None), (4, " \n"), (None, "x"), (5, "a"), (5, "b a")], "doc_id long, text string")
    got = {r.doc_id: np.array(r.vec) for r in encode_texts(rows, "doc_id").collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and all(len(v) == 64 for v in got.values())
    assert (got[1] == got[2]).all() and (got[5] == got[1]).all() and not got[3].any() and not got[4].any()
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-12 and np.abs(got[None]).sum() == 1
    assert encode_texts(rows.filter("false"), "doc_id").isEmpty()


def test_table_functions_on_few_rows(spark):
    table_functions.register(spark)
    items = frame(spark, np.eye(5)[[0, 0, 1, 2, 3]])
    queries = items.filter("item_id < 2").select(F.col("item_id").alias("query_id"), "vec")
    table_functions.dealt_rows(queries, items, 2, 3).createOrReplaceTempView("some_rows")
    table_functions.packed_blocks(items, "item_id", 2).createOrReplaceTempView("some_items")
    table_functions.packed_blocks(queries, "query_id", 1).createOrReplaceTempView("some_queries")
    best = "SELECT query_id, max(similarity) AS s, max_by(item_id, similarity) AS i FROM ({}) GROUP BY query_id ORDER BY query_id"
    for sql in ("SELECT n.* FROM nearest(TABLE(some_rows) PARTITION BY block) n", "SELECT n.* FROM some_queries q JOIN some_items i, LATERAL block_topk(q.ids, q.vecs, i.ids, i.vecs, 2) n"):
        assert [tuple(r) for r in spark.sql(best.format(sql)).collect()] == [(0, 1.0, 1), (1, 1.0, 0)]
