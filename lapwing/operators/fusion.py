"""Feature fusion: gates, projection heads, view pooling, the full forward pass, over Arrow batches of any width.

Weights are small named arrays of fixed size, sent with the function.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.vectors import normalise


def seeded_weights(visual: int, textual: int, hidden: int, shared: int, out: int, seed: int = 42) -> dict[str, np.ndarray]:
    """A deterministic set of weights for all layers."""
    rng = np.random.default_rng(seed)
    shapes = {
        "visual": (visual, shared), "textual": (textual, shared), "gate1": (2 * shared + 2, hidden), "gate2": (hidden, 2),
        "head1": (shared, shared), "head2": (shared, out),
    }
    weights = {k: rng.normal(0, 1 / np.sqrt(a), (a, b)) for k, (a, b) in shapes.items()}
    return weights | {f"{k}_b": np.zeros(b) for k, (_, b) in shapes.items()} | {"norm_w": np.ones(shared), "norm_b": np.zeros(shared)}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(v: np.ndarray, t: np.ndarray, q_v: np.ndarray, q_t: np.ndarray, w: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(unit embeddings, gates): project, gate by a two-layer network on both sides and their qualities, fuse, project, normalise."""
    pv, pt = v @ w["visual"] + w["visual_b"], t @ w["textual"] + w["textual_b"]
    hidden = np.maximum(np.concatenate([pv, pt, q_v[:, None], q_t[:, None]], axis=1) @ w["gate1"] + w["gate1_b"], 0)
    gates = _softmax(hidden @ w["gate2"] + w["gate2_b"])
    x = (gates[:, :1] * pv + gates[:, 1:] * pt) @ w["head1"] + w["head1_b"]
    x = 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))
    x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * w["norm_w"] + w["norm_b"]
    x = x @ w["head2"] + w["head2_b"]
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length), gates


def embed(rows: DataFrame, weights: Mapping[str, np.ndarray]) -> DataFrame:
    """(item_id, embedding, gate_visual, gate_textual) of rows (item_id, visual, textual, q_v, q_t); a missing quality is 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                q = [pdf[c].fillna(1.0).to_numpy() for c in ("q_v", "q_t")]
                x, g = forward(np.array(pdf["visual"].tolist()), np.array(pdf["textual"].tolist()), *q, weights)
                yield pd.DataFrame({"item_id": pdf["item_id"], "embedding": list(x), "gate_visual": g[:, 0], "gate_textual": g[:, 1]})

    return rows.select("item_id", "visual", "textual", "q_v", "q_t").mapInPandas(run, "item_id long, embedding array<double>, gate_visual double, gate_textual double")


def parameter_counts(weights: Mapping[str, np.ndarray], spark) -> DataFrame:
    return spark.createDataFrame([(k, int(v.size)) for k, v in sorted(weights.items())], "layer string, parameters long")


def mean_views(views: DataFrame) -> DataFrame:
    """(sku_id, n_views, vec): mean of the views' vectors, component by component, so that views combine before the shuffle."""
    parts = views.select("sku_id", F.posexplode("vec").alias("i", "x"))
    means = parts.groupBy("sku_id", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("sku_id").agg(F.max("n").alias("n_views"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vec"))


def attention_views(views: DataFrame, score: Column) -> DataFrame:
    """(sku_id, n_views, vec): views weighted by a softmax of their scores over the SKU, normalised; a single view is only normalised."""
    group = Window.partitionBy("sku_id")
    scored = views.withColumn("score", score)
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(group)))
    weighted = e.withColumn("w", F.col("e") / F.sum("e").over(group)).select("sku_id", "w", F.posexplode("vec").alias("i", "x"))
    sums = weighted.groupBy("sku_id", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.count("*").alias("n"))
    pooled = sums.groupBy("sku_id").agg(F.max("n").alias("n_views"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vec"))
    return pooled.withColumn("vec", normalise(F.col("vec")))
