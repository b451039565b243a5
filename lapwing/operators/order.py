"""Exact order statistics without a sort: counts by value range, one range of them descended into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a stretch of values is cut into, and rows of a stretch that are sorted at last.
RANGES, FEW = 1024, 10_000
MOST = 1.7976931348623157e308


def order_statistics(values: DataFrame, column: str, places: Sequence[int]) -> list[float]:
    """The value at each place (from 0) of the sorted, non-missing numbers of ``column``. A round counts the rows of each range of the stretches that hold a
    place, with partial counts before the shuffle; the range with the place is the next stretch. What reaches the driver are ``RANGES`` counts a
    place, or ``FEW`` values. Infinities count as the largest finite numbers. Rounds are as many as it takes to tell values apart: two or three, unless values lie many orders of magnitude apart."""
    number = F.col(column).cast("double")
    rows = values.filter(number.isNotNull() & ~F.isnan(number)).select(F.greatest(F.least(number, F.lit(MOST)), F.lit(-MOST)).alias("x"))
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return []
    # Of each place: the stretch it lies in, and how many rows are under it.
    open_: dict[int, tuple[float, float, int]] = {p: (low, high, 0) for p in places}
    found: dict[int, float] = {}
    while open_:
        for p, (a, b, _) in list(open_.items()):
            if a == b:
                found[p] = a
                del open_[p]
        stretches = sorted({(a, b) for a, b, _ in open_.values()})
        if not stretches:
            break
        each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in stretches])
        cut = rows.select("x", F.explode(F.filter(each, lambda s: F.col("x").between(s["a"], s["b"]))).alias("s"))
        # Halves, so that the width of a stretch is a finite number; where it is too small for one, the least value stands apart.
        share = F.try_divide(F.col("x") / 2 - F.col("s.a") / 2, F.col("s.b") / 2 - F.col("s.a") / 2)
        share = F.coalesce(share, (F.col("x") > F.col("s.a")).cast("double"))
        part = F.least(F.floor(share * RANGES), F.lit(RANGES - 1))
        counts = cut.groupBy("s.a", "s.b", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        small = []
        for p, (a, b, under) in list(open_.items()):
            for r in sorted((r for r in counts if (r["a"], r["b"]) == (a, b)), key=lambda r: r["part"]):
                if p < under + r["n"]:
                    open_[p] = (r["low"], r["high"], under)
                    if r["n"] <= FEW:
                        small.append(p)
                    break
                under += r["n"]
        for p in small:
            a, b, under = open_.pop(p)
            sorted_ = sorted(r["x"] for r in rows.filter(F.col("x").between(a, b)).collect())  # FEW at most
            found[p] = sorted_[p - under]
    return [found[p] for p in places]
