"""Vector arithmetic on arrays of doubles, folded left to right so that every engine gets the same bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, where an expression inside a lambda would be computed per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalise(v: Column) -> Column:
    """``v`` over its norm; a zero vector stays."""
    return let(v, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: x / F.when(n == 0, 1.0).otherwise(n))))


def checked(v: Column, dim: int) -> Column:
    """``v``, or an error where it has not ``dim`` components."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit(f"vectors must have {dim} components")))


def blend(a: Column, b: Column, weight: Column) -> Column:
    """``weight * a + (1 - weight) * b``."""
    return F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)


def fuse(a: Column, b: Column, gate_a: Column, gate_b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: gate_a * x + gate_b * y)


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A small dense layer with literal weights (a row per output)."""
    rows = F.array(*[F.struct(F.array(*map(F.lit, row)).alias("w"), F.lit(b).alias("b")) for row, b in zip(weights, bias)])
    return F.transform(rows, lambda r: dot(v, r["w"]) + r["b"])


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def softmax(v: Column) -> Column:
    exps = let(v, lambda w: let(F.array_max(w), lambda top: F.transform(w, lambda x: F.exp(x - top))))
    return let(exps, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def gelu(v: Column) -> Column:
    """The tanh form of the Gaussian error linear unit."""
    return F.transform(v, lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    def scaled(w: Column, mean: Column) -> Column:
        variance = F.aggregate(w, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(w)
        return let(F.sqrt(variance + eps), lambda d: F.transform(w, lambda x: (x - mean) / d))

    return let(v, lambda w: let(_sum(w) / F.size(w), lambda mean: scaled(w, mean)))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values under a one in the mask; divisor one at least."""
    total = F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0), lambda s, m: s + m), F.lit(1))


def quantised(v: Column) -> Column:
    """Symmetric 8-bit integers: components over the largest magnitude, times 127, rounded half up."""
    top = lambda w: F.array_max(F.transform(w, lambda x: F.abs(x)))
    return let(v, lambda w: let(top(w), lambda t: F.transform(w, lambda x: F.floor(x / F.when(t == 0, 1.0).otherwise(t) * 127 + 0.5).cast("int"))))
