"""Joins with a table of keys that is usually small: broadcast behind a count, salted beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.sources.durable import pin

#: A lookup is broadcast only up to so many rows.
BROADCAST_ROWS = 50_000
SALTS = 32


def look_up(df: DataFrame, table: DataFrame, on: list[str] | str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``df`` with ``table``, which has at most one row per key.

    The table is written once and counted.  Up to ``limit`` rows it is broadcast
    and ``df`` is not moved at all.  Beyond, each key is spread over ``SALTS``
    partitions by a hash of the row, so a frequent or null key fills no single task.
    The spread table is always shuffled: Spark takes it for as small as its file, which
    holds each row once, and would broadcast all ``SALTS`` copies from the driver.
    """
    keys = [on] if isinstance(on, str) else list(on)
    table = pin(table, "lookup")
    if table.count() <= limit:
        return df.join(F.broadcast(table), keys, how)
    plain = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread.hint("merge"), [*keys, "__salt"], how).drop("__salt")
