"""Seeded, partition-independent randomness: md5 of a seed and a row's own key.

md5 of a UTF-8 string is the same in every engine, so samples repeat on any cluster and SQL can check them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(seed: int | str, *keys: Column) -> Column:
    """md5 of ``seed|key|key...`` as hex: an order in which rows can be shuffled."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of ``token``."""
    return F.conv(F.substring(token(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
