"""Streams: late rows, restarts, and draws from one offset."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.streaming import endless, mining, windows

SCHEMA = "item_id long, ts timestamp, event_type string, user_id long"
START = datetime.datetime(2024, 3, 1)


def at(minutes: float) -> datetime.datetime:
    return START + datetime.timedelta(minutes=minutes)


def run(spark, folder, files, rates):
    for n, rows in enumerate(files):
        spark.createDataFrame([(i, at(m), "view", u) for i, m, u in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")  # each file is a run of its own, from the checkpoint of the last
        known = spark.createDataFrame([(1,), (3,), (3,)], "item_id long")
        query = rates(windows.decided(stream, known)).writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").orderBy("from_ts").collect()


def test_late_rows_are_dropped(spark, tmp_path):
    files = [
        [(1, 1, 0), (2, 5, 0), (3, 14, 0)],
        [(1, 62, 0)],  # the watermark is at 52 from here on
        [(3, 7, 0), (1, 55, 0)],  # the first is too late, the second is not
        [(9, 1000, 0)], [(9, 2000, 0)],
    ]
    got = run(spark, str(tmp_path), files, lambda rows: windows.window_rates(rows, "10 minutes", late="10 minutes"))
    want = [(0, 2, 1), (10, 1, 1), (50, 1, 1), (60, 1, 1), (1000, 1, 0)]
    assert [(r.from_ts, r.n_events, r.n_duplicates) for r in got] == [(at(m), n, d) for m, n, d in want]
    assert [r.duplicate_rate for r in got] == [d / n for _, n, d in want]


def test_sessions_end_after_the_gap(spark, tmp_path):
    files = [[(1, 0, 7), (2, 4, 7), (3, 20, 7), (1, 3, 8)], [(3, 23, 7), (9, 30, 8)], [(9, 5000, 9)], [(9, 9000, 9)]]
    got = run(spark, str(tmp_path), files, lambda rows: windows.session_rates(rows, "5 minutes", late="20 minutes"))
    assert sorted((r.user_id, r.from_ts, r.to_ts, r.n_events, r.n_duplicates) for r in got) == [
        (7, at(0), at(9), 2, 1), (7, at(20), at(28), 2, 2), (8, at(3), at(8), 1, 1), (8, at(30), at(35), 1, 0), (9, at(5000), at(5005), 1, 0)]


def test_mining_does_not_depend_on_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], i, int(rng.integers(0, 4)), rng.normal(size=5).tolist()) for i in range(90)]
    schema, found = "bank string, seq long, sku_id long, vec array<double>", []
    for name, cuts in (("one", [90]), ("many", [1, 2, 30, 31, 90])):
        folder, low = str(tmp_path / name), 0
        for high in cuts:
            spark.createDataFrame(rows[low:high], schema).repartition(3).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = mining.mine_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), 8, 2)
            stream.writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
            low = high
        found.append(sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())))
    want = []
    for bank in "ab":
        own = [r for r in rows if r[0] == bank]
        for i, (_, seq, sku, v) in enumerate(own):
            near = sorted((-round(float(np.dot(v, o[3])), 12), o[1]) for o in own[max(0, i - 8) : i] if o[2] != sku)
            if len(near) >= 2:
                want += [(bank, seq, r + 1, n, -s) for r, (s, n) in enumerate(near[:2])]
    assert [(a, b, c, d, pytest.approx(e)) for a, b, c, d, e in found[0]] == sorted(want) and found[0] == found[1]


def test_best_of_missing_values_and_restarts(spark, tmp_path):
    rows = [(1, 1, None), (1, 2, 3.0), (1, 3, 3.0), (1, 4, None), (1, 5, 4.0), (2, 1, -1.0), (2, 2, -2.0)]
    folder = str(tmp_path)
    for some in (rows[:3] + rows[5:6], rows[3:5] + rows[6:]):
        spark.createDataFrame(some, "run long, epoch long, value double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = mining.best_stream(spark.readStream.schema("run long, epoch long, value double").parquet(f"{folder}/in"))
        stream.writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    got = {(r.run, r.epoch): (r.best, r.improved) for r in spark.read.parquet(f"{folder}/out").collect()}
    nan = lambda x: x is None or x != x
    want = {(1, 1): (None, True), (1, 2): (None, True), (1, 3): (3.0, False), (1, 4): (3.0, True), (1, 5): (3.0, True), (2, 1): (None, True), (2, 2): (-1.0, False)}
    assert {k: (None if nan(b) else b, i) for k, (b, i) in got.items()} == want


def test_draws_repeat_from_one_offset(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a{i}") for i in range(10)], "sku_id long, anchor_path string")
    out = []
    for name, batch in (("a", 7), ("b", 7), ("c", 30)):
        query = endless.serve_triplets(endless.draws(spark, 10, batch, start=4, until=29), rows, str(tmp_path / name / "out"), str(tmp_path / name / "log"))
        query.processAllAvailable()
        query.stop()
        got = spark.read.parquet(str(tmp_path / name / "out")).select("draw", "epoch", "sku_id").orderBy("draw").collect()
        out.append([tuple(r) for r in got])
    assert out[0] == out[1] == out[2] and [d for d, _, _ in out[0]] == list(range(4, 29))
    assert sorted(s for _, e, s in out[0] if e == 1) == list(range(10))
    # A query that goes on from its checkpoint serves what comes next, once.
    query = endless.serve_triplets(endless.draws(spark, 10, 7, start=4, until=35), rows, str(tmp_path / "a" / "out"), str(tmp_path / "a" / "log"))
    query.processAllAvailable()
    query.stop()
    assert [r.draw for r in spark.read.parquet(str(tmp_path / "a" / "out")).orderBy("draw").collect()] == list(range(4, 35))
