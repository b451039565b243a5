"""Toxicity by multiple-instance learning: sentences are judged, only documents are labelled.

A document is a bag of sentences. Each sentence has a probability of being toxic, a logistic function of the words
and word beginnings that it holds; a document is toxic if any of its sentences is (noisy-or), or, with a small
probability of its own (the leak), without any sign. The document labels train the sentence weights
through the noisy-or; the same sentence probabilities then tell which sentences offend.

The classifier is fitted on ``SAMPLE_DOCS`` labelled documents at most, up to half of them of each label, those of least hash;
weights restore the labels' shares. Its features (``MOST_FEATURES`` at most) are those that stand in toxic
documents more often than chance explains. All else covers every whole document, in one pass without a shuffle.

Defined results for odd input: a null or empty text has the leak as its score; a null doc_id is carried, is not held out and
trains nothing; repeated rows are scored each; labels of one doc_id count once, as toxic if any is, null labels not at all; without
labels of both kinds there are no features, and the leak is the smoothed share of toxic labels; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import table

SAMPLE_DOCS, MOST_FEATURES, SURPRISE = 16_384, 5_000, 8.0
#: Lengths of word beginnings that are features beside the word itself.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
SPANS = "array<struct<start: int, stop: int, score: double>>"

_word = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*")


def features(token: str) -> list[str]:
    """Features of one blank-separated token: its words in lower case, and their beginnings."""
    found = []
    for word in _word.findall(token.lower()):
        found.append(word)
        found += [word[:n] + "*" for n in BEGINNINGS if len(word) > n]
    return found


class Known(dict):
    """Token -> numbers of its features among ``names``; emptied at ``most`` tokens, long tokens are not kept."""

    def __init__(self, names: dict[str, int], most: int = 300_000):
        super().__init__()
        self.names, self.most = names, most

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = tuple(k for k in map(self.names.get, features(token)) if k is not None)
        if len(self) >= self.most:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found

    def sentences(self, text: str | None) -> list[tuple[int, int, list[int]]]:
        """(start, stop, features) of the sentences that hold features."""
        if not text or not any(map(self.__getitem__, text.split())):
            return []
        out = []
        for m in _sentence.finditer(text):
            if found := sorted({k for token in m[0].split() for k in self[token]}):
                out.append((m.start(), m.end(), found))
        return out


@dataclass(frozen=True)
class Model:
    """A weight for each feature, the sentences' bias, and the leak."""

    weights: dict[str, float]
    bias: float
    leak: float

    def document(self, sentence_scores: list[float]) -> float:
        return 1.0 - (1.0 - self.leak) * float(np.prod(1.0 - np.array(sentence_scores)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_bags(doc: np.ndarray, row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, importance: np.ndarray, n_features: int, steps: int = 1000, penalty: float = 0.8) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that make the labels ``toxic`` of documents likely under the noisy-or. Bags are flat: the document of each
    sentence, and the sentence and the feature of each entry. Weights are not negative, and cost ``penalty`` documents' worth of gradient: a feature that explains
    no more stays at 0, and is left out once it does. Projected gradient steps, each feature's scaled by how often it occurs."""
    docs, sentences = len(toxic), len(doc)
    share = importance / importance.sum()
    silent = np.bincount(doc, minlength=docs) == 0
    leak = float((share[silent & toxic].sum() * docs + 0.5) / (share[silent].sum() * docs + 5))
    w, b = np.zeros(n_features), -3.0
    if not len(feature):
        return w, b, leak
    together = np.bincount(row, minlength=sentences)
    often = np.bincount(feature, weights=(share[doc] * together)[row] / 4, minlength=n_features)
    cost = penalty / docs
    for step in range(1, steps + 1):
        p = _sigmoid(b + np.bincount(row, weights=w[feature], minlength=sentences))
        clear = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs)  # log of no sentence being toxic
        whole = 1.0 - (1.0 - leak) * np.exp(clear)
        pull = np.where(toxic, (1.0 - whole) / np.maximum(whole, 1e-9), -1.0) * share
        g = pull[doc] * p
        grad = np.bincount(feature, weights=g[row], minlength=n_features) - cost
        new = np.maximum(0.0, w + np.clip(grad / (often + 1e-9), -0.5, 0.5))
        moved, w = np.abs(new - w).max(), new
        b = float(np.clip(b + np.clip(g.sum() * 4 / share[doc].sum(), -0.5, 0.5), -8.0, -1.0))
        if moved < 1e-4:
            break
        if step % 50 == 0:
            use = ((w > 0) | (grad > 0))[feature]
            row, feature = row[use], feature[use]
    return w, b, leak


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, importance, text): labelled documents of least hash, up to half of ``most`` of each label."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = []
    for kind in (True, False):
        n = min(counts.get(kind, 0), most // 2)
        some = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        parts.append(some.withColumn("importance", F.lit(counts.get(kind, 0) / max(n, 1))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("doc_id", "toxic", "importance", "text")  # ``most`` short rows


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of the sample that hold each feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                found[not toxic].update({f for token in set((text or "").split()) for f in features(token)})
        names = sorted({*found[0], *found[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in found)], ["feature", "toxic", "clean"])

    rows = sample.select("toxic", "text").mapInArrow(count, "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling(counted: DataFrame, n_toxic: int, n_clean: int, most: int = MOST_FEATURES) -> list[str]:
    """Features more common in toxic documents, by the log-likelihood ratio of their counts, ``SURPRISE`` at least; the ``most`` highest."""
    a, b, share = F.col("toxic"), F.col("clean"), n_toxic / (n_toxic + n_clean)
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    surprise = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    rows = counted.withColumn("surprise", surprise).filter((a > (a + b) * share) & (F.col("surprise") >= SURPRISE))
    return [r[0] for r in rows.orderBy(F.desc("surprise"), "feature").limit(most).select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of ``docs`` (doc_id, text) under ``labels`` (doc_id, toxic) that are not held out."""
    sample = table(_sample(docs, labels, sample_docs), "toxicity-sample")
    n = {r["toxic"]: (r["n"], r["w"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("importance").alias("w")).collect()}
    if len(n) < 2:
        (count, _), kind = next(iter(n.values()), (0, 0)), next(iter(n), False)
        return Model({}, -2.0, (count * kind + 0.5) / (count + 5))
    names = telling(_counted(sample), n[True][0], n[False][0])
    place = {f: k for k, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(place)
        packed = lambda x: np.array(x, np.int32).tobytes()
        for batch in batches:
            found = [[s for _, _, s in known.sentences(x.as_py())] for x in batch.column("text")]
            sizes, entries = [packed([len(s) for s in bag]) for bag in found], [packed([k for s in bag for k in s]) for bag in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("importance"), pa.array(sizes, pa.binary()), pa.array(entries, pa.binary())], ["toxic", "importance", "sizes", "entries"])

    rows = sample.select("toxic", "importance", "text").mapInArrow(bags, "toxic boolean, importance double, sizes binary, entries binary").toPandas()  # of the bounded sample
    sizes, entries = (np.frombuffer(b"".join(rows[c]), np.int32) for c in ("sizes", "entries"))
    doc = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows["sizes"]])
    w, b, leak = fit_bags(doc, np.repeat(np.arange(len(sizes)), sizes), entries, rows["toxic"].to_numpy(bool), rows["importance"].to_numpy(), len(names))
    return Model({f: float(x) for f, x in zip(names, w) if x > 0}, b, leak)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, offending: float = 0.5) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): score, predicted, and the sentences (places of characters) of a probability of ``offending`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known({f: k for k, f in enumerate(model.weights)})
        weights = np.array(list(model.weights.values()))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, where = [], []
            for text in batch.column("text"):
                found = known.sentences(text.as_py())
                each = [float(_sigmoid(model.bias + weights[s].sum())) for _, _, s in found]
                scores.append(model.document(each))
                where.append([(i, j, p) for (i, j, _), p in zip(found, each) if p >= offending])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(where, spans)], ["doc_id", "score", "sentences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, score double, sentences {SPANS}")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` (doc_id, text) scored by a model of ``labels`` (doc_id, toxic): doc_id, held_out, score, predicted, sentences."""
    return score(docs, fit(docs, labels, sample_docs))
