"""Quality of similarity: pairwise F1, precision and recall at k, losses, histories, latencies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators.blocks import top_k
from lapwing.operators.order import order_statistics
from lapwing.operators.threshold import threshold_counts


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 over 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pairwise_f1(items: DataFrame, thresholds: Sequence[float] = (0.7,)) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) over all pairs of items (item_id, sku_id, vec of norm 1)."""
    out = threshold_counts(items, list(thresholds)).drop("compared")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def precision_recall(items: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(k, n_queries, precision, recall): every item is a query against the others; hits over k, and over the matches
    there are (k at most); queries whose SKU has no other item do not count. One ranking serves all k, and it need not go under the matches."""
    ranked = top_k(items.select(F.col("item_id").alias("query_id"), "vec"), items, max(ks), same=True, mates=True)
    sku = items.select("item_id", "sku_id")
    others = items.groupBy("sku_id").agg((F.count("*") - 1).alias("others")).filter("others > 0")
    queries = sku.join(others, "sku_id").select(F.col("item_id").alias("query_id"), F.col("sku_id").alias("own"), "others")
    hits = ranked.join(queries, "query_id").join(sku, "item_id").withColumn("hit", (F.col("own") == F.col("sku_id")).cast("int"))
    per = hits.groupBy("query_id").agg(F.max("others").alias("others"), *[F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / F.lit(float(k))).alias("p"), (F.col(f"h{k}") / F.least("others", F.lit(k))).alias("r")) for k in ks])
    return per.select(F.explode(rows).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.count("*").alias("n_queries"), F.avg("x.p").alias("precision"), F.avg("x.r").alias("recall"))


def info_nce(batches: DataFrame, temperature: float = 0.07, symmetric: bool = False) -> DataFrame:
    """(batch, n, loss) of contrastive batches (batch, pos, anchor, positive): cross-entropy of each anchor's scaled products
    with the batch's positives, its own as the target; ``symmetric`` averages both directions. With a column ``hard`` (arrays of
    vectors, equally many), each anchor's products with its own hard negatives stand beside these, and ``symmetric`` has no effect. A
    batch is one group, of the training batch's size. The temperature is clamped to .01 to 1."""
    t = min(1.0, max(0.01, temperature))
    hard = "hard" in batches.columns

    def loss(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, p = np.array(pdf["anchor"].tolist()), np.array(pdf["positive"].tolist())
        logits = a @ p.T / t

        def one(x: np.ndarray) -> float:
            top = x.max(axis=1)
            return float(np.mean(top + np.log(np.exp(x - top[:, None]).sum(axis=1)) - np.diag(x)))

        if hard:
            own = np.array([[list(v) for v in vs] for vs in pdf["hard"]], np.float64).reshape(len(a), -1, a.shape[1])
            logits = np.concatenate([logits, np.einsum("bd,bkd->bk", a, own) / t], axis=1)
        value = (one(logits) + one(logits.T)) / 2 if symmetric and not hard else one(logits)
        return pd.DataFrame({"batch": [key[0]], "n": [len(pdf)], "loss": [value]})

    return batches.groupBy("batch").applyInPandas(loss, "batch long, n long, loss double")


def hard_negatives(anchors: DataFrame, bank: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` bank rows (item_id, sku_id, vec) nearest each anchor (query_id, sku_id, vec) of another SKU; none where fewer
    than ``k`` are left."""
    found = top_k(anchors, bank, k, drop_self=False, other_sku=True)
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    return found.join(enough, "query_id", "left_semi")


def ring(arrivals: DataFrame, size: int) -> DataFrame:
    """The last ``size`` arrivals (seq, ...): the state of a first-in first-out bank after them all."""
    return arrivals.orderBy(F.desc("seq")).limit(size)


def epoch_means(history: DataFrame) -> DataFrame:
    """(run, epoch, n, mean) of the batches' values (run, epoch, value)."""
    return history.groupBy("run", "epoch").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def best_so_far(history: DataFrame) -> DataFrame:
    """``history`` (run, epoch, value) with ``best`` before each epoch of its run, and whether the epoch improves on it."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("best", F.max("value").over(before)).withColumn("improved", F.coalesce(F.col("value") > F.col("best"), F.lit(True)))


def latency_quantiles(times: DataFrame, value: str = "value", at: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(q, value): the element at ``int(q * n)`` of the sorted values; none without values."""
    n = times.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    found = order_statistics(times, value, [min(int(q * n), n - 1) for q in at])
    return times.sparkSession.createDataFrame(list(zip(map(float, at), found)), "q double, value double")
