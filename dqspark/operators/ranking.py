"""Order-based building blocks that never sort one group in one task.

``nth_by_hash`` finds the n-th row of a random permutation per group by counting
hash buckets first; ``running_sums`` turns a global cumulative sum into bucket
totals plus a window inside each bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.hashing import order_key
from dqspark.operators.lookup import look_up

_BUCKET_DIGITS = 4  # 65,536 hash buckets per group


def nth_by_hash(df: DataFrame, group: str, wanted: DataFrame, seed: int | str, key: str) -> DataFrame:
    """For each (group, n) in ``wanted``, the hash and key of the n-th row by ``order_key``.

    ``key`` must be unique and ``group`` non-null.  Only the one bucket that
    holds the n-th row is ever ranked, 1/65,536 of the group.
    """
    hashed = df.select(group, F.col(key).alias("__k"), order_key(seed, F.col(key)).alias("__h"))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, _BUCKET_DIGITS))
    sizes = hashed.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(group).orderBy("__b"))
    cumulative = sizes.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__n"))
    boundary = (
        cumulative.join(wanted, group)
        .filter((F.col("__before") < F.col("n")) & (F.col("n") <= F.col("__upto")))
        .select(group, "__b", "n", (F.col("n") - F.col("__before")).alias("__pos"))
    )
    place = F.row_number().over(Window.partitionBy(group, "n").orderBy("__h", "__k"))
    return (
        hashed.join(boundary, [group, "__b"])
        .withColumn("__place", place)
        .filter(F.col("__place") == F.col("__pos"))
        .select(group, "n", F.col("__h").alias("cut_hash"), F.col("__k").alias("cut_key"))
    )


def at_or_before(seed: int | str, key: Column, cut_hash: Column, cut_key: Column) -> Column:
    """Whether a row stands at or before a cut in hash order; false without a cut."""
    h = order_key(seed, key)
    return F.coalesce((h < cut_hash) | ((h == cut_hash) & (key <= cut_key)), F.lit(False))


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.25, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: per label ``min(max(1, half-even(n * share)), n - 1)`` rows, singletons train.

    The counting pass moves one row per label and hash bucket; the rows
    themselves are only compared with their label's cut.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    quota = F.least(
        F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(test_size))), F.col("__n") - 1
    ).cast("bigint")
    wanted = counts.filter(F.col("__n") >= 2).select(label, quota.alias("n"))
    cuts = nth_by_hash(df, label, wanted, seed, key).drop("n")
    return look_up(df, cuts, label).withColumn(
        "is_test", at_or_before(seed, F.col(key), F.col("cut_hash"), F.col("cut_key"))
    ).drop("cut_hash", "cut_key")


def sample_exact_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer), the same ones on every run."""
    one = df.sparkSession.range(1).select(F.lit(0).alias("__g"), F.lit(n).cast("bigint").alias("n"))
    cuts = nth_by_hash(df.withColumn("__g", F.lit(0)), "__g", one, seed, key).drop("n")
    # no cut means fewer than n rows: everything is in the sample
    flagged = df.withColumn("__g", F.lit(0)).join(F.broadcast(cuts), "__g", "left")
    keep = F.col("cut_hash").isNull() | at_or_before(
        seed, F.col(key), F.col("cut_hash"), F.col("cut_key")
    )
    return flagged.filter(keep).select(*df.columns)


def running_sums(
    df: DataFrame, order: str, sums: list[str], descending: bool = False, buckets: int | None = None
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive, in ``order``) and ``total_<s>`` for every column in ``sums``.

    ``df`` holds one row per distinct ``order`` value.  Quantile bounds, at most
    one number per bucket, come to the driver so that all branches and retries
    cut at the same places.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probabilities = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(order, probabilities, 0.25 / buckets))) if buckets > 1 else []
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        bucketizer = Bucketizer(splits=splits, inputCol="__v", outputCol="__b", handleInvalid="keep")
        placed = bucketizer.transform(df.withColumn("__v", F.col(order).cast("double"))).drop("__v")
    else:
        placed = df.withColumn("__b", F.lit(0.0))
    by_bucket = F.col("__b").desc() if descending else F.col("__b").asc()
    by_value = F.col(order).desc() if descending else F.col(order).asc()
    over_buckets = Window.partitionBy(F.lit(0)).orderBy(by_bucket)
    everything = Window.partitionBy(F.lit(0))
    totals = placed.groupBy("__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    offsets = totals.select(
        "__b",
        *[(F.sum(f"__t_{s}").over(over_buckets) - F.col(f"__t_{s}")).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(everything).alias(f"total_{s}") for s in sums],
    )
    within = Window.partitionBy("__b").orderBy(by_value)
    return (
        placed.join(F.broadcast(offsets), "__b")
        .withColumns({f"cum_{s}": F.sum(s).over(within) + F.col(f"__o_{s}") for s in sums})
        .drop("__b", *[f"__o_{s}" for s in sums])
    )
