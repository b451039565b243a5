"""All pairs of vectors whose product reaches a threshold, without comparing all pairs.

Vectors are placed in cells; neighbouring cells are laid into blocks of bounded size. Two blocks meet only if some of
their cells may hold a pair at the threshold, by their centres and radii. Where blocks meet, each
vector is held against the other block's cells first, and only what its own bound leaves is multiplied: in
single precision, within whose error a product may reach the threshold; those few are decided in double precision.

A cell of more rows than a block is dealt to several blocks. Every result is exact: a link, a count or a pair for each two items, once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.operators.blocks import _forest, scanned_counts
from lapwing.operators.cells import SINGLE_SLACK, Cells, angles, cell_count, centres_of, measured, placed, sample_of, sampled_centres, units, unpack
from lapwing.sources.shared import stored

PAIR = ["g", "p", "h", "q"]
#: Where cells leave a larger share of all products than this, they are not worth the copies that they cost.
WORTHWHILE = 0.3
#: Pairs whose vectors are taken side by side at once.
DECIDED = 50_000


def _chain(centres: np.ndarray) -> list[int]:
    """The cells in an order in which each follows a near one."""
    left, order = set(range(1, len(centres))), [0]
    near = centres @ centres.T
    while left:
        rest = np.fromiter(left, np.int64)
        order.append(int(rest[np.argmax(near[order[-1], rest])]))
        left.remove(order[-1])
    return order


def _layout(cells: Cells, threshold: float, block_rows: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(cell, group, parts) of each cell, and (group, other, parts of other) of each two groups that may hold a pair."""
    may = cells.pair_bounds() >= threshold - SINGLE_SLACK if threshold > 0 else np.ones((len(cells.rows), len(cells.rows)), bool)
    group, held, at, parts = np.zeros(len(cells.rows), np.int64), 0, -1, []
    for c in _chain(cells.centres):
        if at < 0 or held + cells.rows[c] > block_rows:
            at, held = at + 1, 0
            parts.append(1)
        group[c] = at
        held += cells.rows[c]
        parts[at] = max(1, -(-int(held) // block_rows))
    meet = np.zeros((len(parts), len(parts)), bool)
    a, b = np.nonzero(may & (cells.rows > 0)[:, None] & (cells.rows > 0)[None, :])
    meet[group[a], group[b]] = True
    return [(c, int(group[c]), parts[group[c]]) for c in range(len(group))], [(int(g), int(h), parts[h]) for g, h in zip(*np.nonzero(meet))]


def _meeting(rows: DataFrame, cells: Cells, threshold: float, block_rows: int):
    """``rows`` (item_id, vec, cell, ...) grouped by pairs of blocks; ``first`` marks the rows of the pair's first block."""
    spark = rows.sparkSession
    homes, meets = _layout(cells, threshold, block_rows)
    homes = spark.createDataFrame(homes, "cell int, g0 int, parts int")
    meets = spark.createDataFrame(meets, "g0 int, h0 int, others int")  # MOST_CELLS squared at most
    rows = rows.join(F.broadcast(homes), "cell").withColumn("p0", F.pmod(F.xxhash64("item_id"), "parts").cast("int")).drop("parts")
    rows = rows.join(F.broadcast(meets), "g0").withColumn("q0", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).drop("others")
    own, other = F.struct(F.col("g0").alias("x"), F.col("p0").alias("y")), F.struct(F.col("h0").alias("x"), F.col("q0").alias("y"))
    rows = rows.withColumns({"low": F.least(own, other), "high": F.greatest(own, other), "first": own <= other, "alone": own == other})
    rows = rows.withColumns({"g": F.col("low.x"), "p": F.col("low.y"), "h": F.col("high.x"), "q": F.col("high.y")})
    return rows.drop("g0", "p0", "h0", "q0", "low", "high").groupBy(*PAIR)


def _candidates(pdf: pd.DataFrame, cells: Cells, threshold: float, slab: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(places, places, products, compared) of the pairs of a block pair that may reach the threshold, each once, a slab at a time."""
    x, cell = unpack(pdf["vec"]), pdf["cell"].to_numpy()
    alone, first = bool(pdf["alone"].iloc[0]), pdf["first"].to_numpy()
    left, right = (np.arange(len(pdf)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
    if not len(left) or not len(right):
        return
    right = right[np.argsort(cell[right], kind="stable")]
    names, starts = np.unique(cell[right], return_index=True)
    single, norm = x.astype(np.float32), np.linalg.norm(x, axis=1)
    open_to = cells.bounds(x[left], names) >= threshold - SINGLE_SLACK if threshold > 0 else np.ones((len(left), len(names)), bool)
    for k, (c, start, stop) in enumerate(zip(names, starts, [*starts[1:], len(right)])):
        some = left[open_to[:, k]]
        if alone:
            some = some[cell[some] <= c]  # the other half of a pair of cells is the same pairs
        own = right[start:stop]
        for at in range(0, len(some), slab):
            i = some[at : at + slab]
            near = single[i] @ single[own].T
            slack = SINGLE_SLACK * max(1.0, float(norm[i].max()) * float(norm[own].max()))
            hit = np.flatnonzero(near.ravel() >= threshold - slack)
            a, b = i[hit // len(own)], own[hit % len(own)]
            if alone:
                use = (cell[a] < c) | (a < b)
                a, b = a[use], b[use]
            for part in range(0, max(1, len(a)), DECIDED):
                u, v = a[part : part + DECIDED], b[part : part + DECIDED]
                yield u, v, np.einsum("ij,ij->i", x[u], x[v]), len(i) * len(own) if not part else 0


def open_share(items: DataFrame, threshold: float, most: int = 512) -> float:
    """Which share of all products cells leave to be taken, estimated on a sample (1 without items)."""
    _, sample = sample_of(items, "item_id")
    if not len(sample) or threshold <= 0:
        return 1.0
    centres = centres_of(sample, cell_count(len(sample)))
    apart, norm = angles(units(sample), centres), np.linalg.norm(sample, axis=1)
    cell = np.argmin(apart, axis=1)
    radius, longest = np.zeros(len(centres)), np.zeros(len(centres))
    np.maximum.at(radius, cell, apart[np.arange(len(cell)), cell])
    np.maximum.at(longest, cell, norm)
    cells = Cells(centres, radius, longest, np.bincount(cell, minlength=len(centres)))
    return float(((cells.bounds(sample[:most]) >= threshold - SINGLE_SLACK) @ cells.rows).mean() / len(sample))


def prepared(rows: DataFrame, items: DataFrame) -> tuple[DataFrame, Cells]:
    """``rows`` (item_id, vec, ...) placed in cells that are fitted on ``items``, as a stored table."""
    centres = sampled_centres(items)
    if not len(centres):
        return placed(rows, np.zeros((1, 1))), Cells(np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.zeros(1, np.int64))
    rows = stored(placed(rows, centres), "placed")
    return rows, measured(rows, centres)


def threshold_links(items: DataFrame, threshold: float, digits: int = 12, block_rows: int = 16_384) -> DataFrame:
    """(a, b): links that join the same items (item_id, vec) as all pairs of a product (to ``digits`` places) at the threshold or more: a
    spanning forest for each pair of blocks. Equal vectors are linked to the least of them and compared once."""
    # Equal vectors whose own product is under the threshold are no link: each is compared for itself.
    linked = F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), digits) >= threshold
    named = items.filter(linked).select("item_id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(2), "vec").alias("g"))
    least = named.groupBy("h", "g").agg(F.min("item_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stored(named.join(least, ["h", "g"]).filter("item_id <> first").select(F.col("item_id").alias("a"), F.col("first").alias("b")), "copies")
    one = items.select("item_id", "vec").join(copies.select(F.col("a").alias("item_id")), "item_id", "left_anti")
    rows, cells = prepared(one, items)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id", ignore_index=True)
        ids, held = pdf["item_id"].to_numpy(), 0
        root, links = np.arange(len(ids)), []

        def settle() -> np.ndarray:
            joined = np.flatnonzero(root != np.arange(len(ids)))
            a, b = (np.concatenate(x) for x in zip((joined, root[joined]), *links))
            return _forest(a, b, len(ids))

        for a, b, s, _ in _candidates(pdf, cells, threshold):
            use = np.round(s, digits) >= threshold
            links.append((a[use], b[use]))
            held += len(links[-1][0])
            if held >= 1_000_000:
                root, links, held = settle(), [], 0
        root = settle()
        joined = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[joined], "b": ids[root[joined]]})

    found = _meeting(rows.select("item_id", "vec", "cell"), cells, threshold, block_rows).applyInPandas(link, "a long, b long")
    return copies.unionByName(found)


def threshold_pairs(items: DataFrame, threshold: float, digits: int = 12, block_rows: int = 2048) -> DataFrame:
    """(a, b, similarity) of all pairs of items (item_id, vec) with a product (to ``digits`` places) at the threshold or more, a < b."""
    rows, cells = prepared(items.select("item_id", "vec"), items)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, out = pdf["item_id"].to_numpy(), []
        for a, b, s, _ in _candidates(pdf, cells, threshold):
            s = np.round(s, digits)
            use = s >= threshold
            a, b = ids[a[use]], ids[b[use]]
            out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s[use]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})

    return _meeting(rows.select("item_id", "vec", "cell"), cells, threshold, block_rows).applyInPandas(pairs, "a long, b long, similarity double")


def _counted(items: DataFrame, thresholds: Sequence[float], block_rows: int) -> DataFrame:
    """(threshold, tp, fp, compared) in parts to be summed: pairs of items (sku_id, vec) at each threshold or more, by whether their SKUs are
    equal. Items of one SKU and vector count as one row with their number, so a vector that many share is compared once."""
    least = min(thresholds)
    groups = items.groupBy(F.xxhash64("sku_id").alias("sku"), "vec").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
    rows, cells = prepared(groups, items)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        sku, n, x = pdf["sku"].to_numpy(), pdf["n"].to_numpy(), unpack(pdf["vec"])
        tp, fp, compared = np.zeros(len(thresholds), np.int64), np.zeros(len(thresholds), np.int64), 0
        for a, b, s, work in _candidates(pdf, cells, least):
            equal, pairs = sku[a] == sku[b], n[a] * n[b]
            compared += work
            for k, t in enumerate(thresholds):
                tp[k] += pairs[equal & (s >= t)].sum()
                fp[k] += pairs[~equal & (s >= t)].sum()
        if pdf["alone"].iloc[0]:  # pairs within a row, counted where it meets itself
            s, own = np.einsum("ij,ij->i", x, x), n * (n - 1) // 2
            tp += [int(own[s >= t].sum()) for t in thresholds]
        return pd.DataFrame({"threshold": thresholds, "tp": tp, "fp": fp, "compared": compared})

    return _meeting(rows.select("item_id", "sku", "n", "vec", "cell"), cells, least, block_rows).applyInPandas(count, "threshold double, tp long, fp long, compared long")


def threshold_counts(items: DataFrame, thresholds: Sequence[float], block_rows: int = 16_384) -> DataFrame:
    """(threshold, tp, fp, fn, compared) over all pairs of items (item_id, sku_id, vec): predicted at the threshold or more, true for one SKU;
    ``compared`` is how many products were computed for that. Over cells where a sample says that these leave few products, else block by block, as each meeting of cells
    copies their rows."""
    spark = items.sparkSession
    parts = scanned_counts(items, list(thresholds)) if open_share(items, min(thresholds)) > WORTHWHILE else _counted(items, list(thresholds), block_rows)
    found = parts.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "compared")])
    n = F.col("n")
    true = items.groupBy("sku_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0).cast("long")).alias("true"))
    every = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double").crossJoin(true)  # one row for each threshold
    out = every.join(F.broadcast(found), "threshold", "left").fillna(0, ["tp", "fp", "compared"])
    return out.select("threshold", "tp", "fp", (F.col("true") - F.col("tp")).alias("fn"), "compared")
