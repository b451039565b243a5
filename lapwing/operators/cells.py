"""Cells of vectors, and what their radii prove.

A cell is a centre with the vectors nearest to it by angle. Its radius is the largest angle to its centre, so by the triangle
inequality no vector of it is nearer to another direction than that direction's angle to the centre less the
radius: an upper bound of inner products for a whole cell, from the centre alone. On vectors with structure most cells are ruled out;
on vectors without any, nothing is, and the work is that of all pairs.

Centres are fitted on ``SAMPLE_ROWS`` vectors of least hash; all vectors are assigned, and radii cover all of them. Cells are
``MOST_CELLS`` at most, so their numbers may be sent to tasks and held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.sources.shared import least_hashes

SAMPLE_ROWS, MOST_CELLS = 16_384, 1024
#: What rounding may do to an angle, and to a product of unit vectors in single precision.
ANGLE_SLACK, SINGLE_SLACK = 1e-6, 2e-5


def unpack(vectors: pd.Series) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1.0)[:, None]


def angles(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ centres.T, -1.0, 1.0))


@dataclass(frozen=True)
class Cells:
    """Unit ``centres``; of each cell's vectors the largest angle to the centre, the largest norm and the number."""

    centres: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    rows: np.ndarray

    def bounds(self, x: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """No vector of a cell has a larger product with a row of ``x`` than this (rows by cells), 0 where that is negative."""
        apart = np.maximum(angles(units(x), self.centres[some]) - self.radius[some] - ANGLE_SLACK, 0.0)
        return np.linalg.norm(x, axis=1)[:, None] * self.norm[some] * np.maximum(np.cos(apart), 0.0)

    def pair_bounds(self) -> np.ndarray:
        """The same for the vectors of two cells."""
        apart = np.maximum(angles(self.centres, self.centres) - self.radius[:, None] - self.radius[None, :] - ANGLE_SLACK, 0.0)
        return self.norm[:, None] * self.norm[None, :] * np.maximum(np.cos(apart), 0.0)


def cell_count(n: int) -> int:
    return int(min(MOST_CELLS, max(8, 2 * np.sqrt(n))))


def fit_centres(sample: np.ndarray, n: int, seed: int = 42, rounds: int = 8) -> np.ndarray:
    """``n`` unit centres of unit vectors: seeds far from each other, then means of what is nearest."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    far = 1.0 - sample @ centres[0]
    for _ in range(1, min(n, len(sample))):
        weight = np.maximum(far, 0.0) ** 2
        if weight.sum() <= 1e-12:
            break
        centres.append(sample[rng.choice(len(sample), p=weight / weight.sum())])
        far = np.minimum(far, 1.0 - sample @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        at = np.argmax(sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, at, sample)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centres


def sample_of(rows: DataFrame, key: str, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``most`` rows (key, vec) of least hash. Vectors are taken once: their number is that of the keys, and the hashes that it suggests hold the
    sample unless many rows have no vector or the same key."""
    held, n = rows.filter("vec is not null").select(key, "vec"), rows.select(key).count()
    some = None
    if n > 2 * most:
        few = held.filter(F.xxhash64(key) < F.lit(int(-(2**63) + (most + 8 * most**0.5 + 64) / n * 2**64)))
        some = few.repartition(1).orderBy(F.xxhash64(key), key).limit(most).toPandas()
    if some is None or len(some) < most:
        some = least_hashes(held, key, most).toPandas()
    return some[key].to_numpy(), np.array(some["vec"].tolist(), np.float64)


def centres_of(sample: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """``n`` centres of the vectors of a sample, zero vectors left out."""
    some = units(sample[np.abs(sample).sum(axis=1) > 0])
    return fit_centres(some, n, seed) if len(some) else sample[:1]


def sampled_centres(items: DataFrame, n: int | None = None, seed: int = 42) -> np.ndarray:
    """``n`` centres for ``items`` (item_id, vec), or as many as suit their number; none for no items."""
    _, sample = sample_of(items, "item_id")
    if not len(sample):
        return np.zeros((0, 0))
    return centres_of(sample, n or cell_count(len(sample) if len(sample) < SAMPLE_ROWS else items.count()), seed)


def placed(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """``items`` with ``vec`` (array of doubles) packed, and ``cell``, ``angle`` to its centre and ``norm``; rows without a vector go."""
    columns = [c for c in items.columns if c != "vec"]
    kinds = dict(items.dtypes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vec"].tolist(), np.float64)
                apart = angles(units(x), centres)
                cell = np.argmin(apart, axis=1)
                yield pdf.assign(vec=[r.tobytes() for r in x], cell=cell.astype(np.int32), angle=apart[np.arange(len(x)), cell], norm=np.linalg.norm(x, axis=1))[[*columns, "vec", "cell", "angle", "norm"]]

    rows = items.filter("vec is not null").select(*columns, F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInPandas(place, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", vec binary, cell int, angle double, norm double")


def measured(rows: DataFrame, centres: np.ndarray) -> Cells:
    """The cells of ``placed`` rows."""
    radius, norm, n = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect():
        radius[r["cell"]], norm[r["cell"]], n[r["cell"]] = r["radius"], r["norm"], r["n"]
    return Cells(centres, radius, norm, n)
