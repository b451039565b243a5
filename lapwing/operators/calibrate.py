"""Decision thresholds per category by smoothed F1 over counted similarities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.text import threshold_band

DEFAULT = "__default__"
FALLBACK = 0.70


def smoothed_f1(tp: Column, fp: Column, fn: Column, alpha: float = 2.0, beta: float = 2.0) -> Column:
    """F1 of precision and recall under Beta priors."""
    p = (tp + alpha) / (tp + fp + alpha + beta)
    r = (tp + alpha) / (tp + fn + alpha + beta)
    return 2 * p * r / (p + r)


def curve(pairs: DataFrame, alpha: float = 2.0, beta: float = 2.0) -> DataFrame:
    """(category, threshold, tp, fp, fn, f1) at each similarity that occurs in ``pairs`` (category, similarity, label, n): sums
    down the order of similarity, ties together. Similarities are rounded, so a category has boundedly many."""
    each = pairs.groupBy("category", "similarity").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))
    down = Window.partitionBy("category").orderBy(F.desc("similarity"))
    out = each.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "fn": F.sum("pos").over(Window.partitionBy("category"))})
    out = out.withColumn("fn", F.col("fn") - F.col("tp"))
    return out.select("category", F.col("similarity").alias("threshold"), "tp", "fp", "fn", smoothed_f1(F.col("tp"), F.col("fp"), F.col("fn"), alpha, beta).alias("f1"))


def pooled(pairs: DataFrame) -> DataFrame:
    """``pairs`` and, as one more category, all of them together."""
    together = pairs.groupBy("similarity", "label").agg(F.sum("n").alias("n")).select(F.lit(DEFAULT).alias("category"), "similarity", "label", "n")
    return pairs.unionByName(together)


def usable(items: DataFrame, pairs: DataFrame, least_items: int = 4) -> DataFrame:
    """The ``pairs`` (category, similarity, label, n) of categories that can be calibrated: ``least_items`` items (category, ...) or more, and a pair of one SKU."""
    large = items.groupBy(F.col("category").cast("string").alias("c")).count().filter(F.col("count") >= least_items).select("c")
    positive = pairs.groupBy(F.col("category").alias("p")).agg(F.sum(F.col("label") * F.col("n")).alias("positives")).filter("positives > 0").select("p")
    return pairs.join(large, F.col("category") == F.col("c"), "left_semi").join(positive, F.col("category") == F.col("p"), "left_semi")


def best_thresholds(pairs: DataFrame, low: float = 0.30, high: float = 0.99, alpha: float = 2.0, beta: float = 2.0) -> DataFrame:
    """(category, threshold, f1): the similarity of largest F1 between ``low`` and ``high`` (of several, the least), for
    each category and pooled; .70 where none lies between."""
    points = curve(pooled(pairs), alpha, beta)
    inside = F.col("threshold").between(low, high)
    best = points.groupBy("category").agg(F.max(F.when(inside, F.struct(F.round("f1", 12).alias("f1"), (-F.col("threshold")).alias("minus")))).alias("b"))
    return best.select("category", F.coalesce(-F.col("b.minus"), F.lit(FALLBACK)).alias("threshold"), F.col("b.f1").alias("f1"))


def golden_thresholds(pairs: DataFrame, low: float = 0.30, high: float = 0.99, alpha: float = 2.0, beta: float = 2.0) -> DataFrame:
    """(category, threshold) by golden-section search with parabolic steps (Brent's bounded minimiser), which stops on
    plateaus of the step function; kept for comparison with thresholds fitted that way."""
    points = curve(pooled(pairs), alpha, beta)

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("threshold")
        cuts, f1 = pdf["threshold"].to_numpy(), pdf["f1"].to_numpy()
        positives = int(pdf["tp"].max())
        none = 2 * (0.5 * alpha / (positives + alpha + beta)) / (0.5 + alpha / (positives + alpha + beta)) if positives or len(pdf) else 0.0

        def cost(t: float) -> float:
            i = cuts.searchsorted(t)
            return -(f1[i] if i < len(cuts) else none)

        return pd.DataFrame({"category": [key[0]], "threshold": [bounded_minimum(cost, low, high)]})

    return points.groupBy("category").applyInPandas(search, "category string, threshold double")


def bounded_minimum(f, a: float, b: float, tolerance: float = 1e-5, steps: int = 500) -> float:
    """Brent's method on [a, b]: a parabola through three points where it is trusted, else the golden section."""
    golden = (3 - math.sqrt(5)) / 2
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    step = last = 0.0
    for _ in range(steps):
        middle, near = (a + b) / 2, math.sqrt(2.2e-16) * abs(x) + tolerance / 3
        if abs(x - middle) <= 2 * near - (b - a) / 2:
            break
        parabola = False
        if abs(last) > near:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            before, last = last, step
            if abs(p) < abs(q * before / 2) and q * (a - x) < p < q * (b - x):
                step, parabola = p / q, True
                if min(x + step - a, b - x - step) < 2 * near:
                    step = math.copysign(near, middle - x)
        if not parabola:
            last = (a if x >= middle else b) - x
            step = golden * last
        u = x + (step if abs(step) >= near else math.copysign(near, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def lookup(requests: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``requests`` (category, ...) with ``threshold_used``: the category's, else the pooled one, else .70."""
    named = thresholds.select(F.col("category").alias("c"), F.col("threshold").alias("t"))
    fallback = thresholds.agg(F.max(F.when(F.col("category") == DEFAULT, F.col("threshold"))).alias("d"))
    out = requests.join(named, F.col("category") == F.col("c"), "left").crossJoin(F.broadcast(fallback))
    return out.withColumn("threshold_used", F.coalesce("t", "d", F.lit(FALLBACK))).drop("c", "t", "d")


def category_search(thresholds: DataFrame, asked: str = "") -> DataFrame:
    """``thresholds`` (category, threshold) whose category holds ``asked`` (trimmed, in capitals; all for an empty one), with the ``band`` of each."""
    wanted = asked.strip().upper()
    found = thresholds.filter(F.col("category").contains(wanted)) if wanted else thresholds
    return found.select("category", "threshold", threshold_band(F.col("threshold")).alias("band"))
