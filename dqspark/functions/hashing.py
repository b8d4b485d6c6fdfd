"""Repeatable pseudo-random choices from a seed and a row key.

``rand()`` changes with partitioning; an md5 of seed and key does not, so a
lost task recomputes the same sample, split or damage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, key: Column) -> Column:
    """Hex string whose order is a random permutation of the keys."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def draw(seed: int | str, key: Column) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("bigint")


def draw_between(seed: int | str, key: Column, low: int, high: int) -> Column:
    """Uniform integer in [low, high]."""
    return draw(seed, key) % (high - low + 1) + low
