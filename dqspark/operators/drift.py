"""Distribution drift: PSI over categories, two-sample KS over lengths.

A profile is one long table (metric, bucket, count): category counts, null
buckets and a value-to-count histogram of text lengths.  It is built in one
pass and compared with another profile, so raw rows are read once per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.tails import kolmogorov_p
from dqspark.operators.ranking import running_sums, sample_exact_n
from dqspark.sources.durable import pin

# --- fixed values ---------------------------------------------------------------
FLOOR = 1e-4
PSI_MODERATE, PSI_SIGNIFICANT = 0.1, 0.25
KS_MODERATE, KS_SIGNIFICANT = 0.05, 0.01
BASELINE_ROWS, BATCH_ROWS = 12_000, 6_000
# --------------------------------------------------------------------------------


def bucket_of(value: Column) -> Column:
    """Category name; null counts as the category ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def null_bucket(value: Column) -> Column:
    return F.when(value.isNull(), "null").otherwise("non_null")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(bucket_of(F.col(column)).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def null_buckets(df: DataFrame, column: str) -> DataFrame:
    """Always the two rows ``null`` and ``non_null``."""
    counts = df.agg(F.count_if(F.col(column).isNull()).alias("a"), F.count(column).alias("b"))
    return counts.select(F.explode(F.array(
        F.struct(F.lit("null").alias("bucket"), F.col("a").alias("count")),
        F.struct(F.lit("non_null").alias("bucket"), F.col("b").alias("count")),
    )).alias("x")).select("x.*")


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """(length, count) of the non-null texts."""
    return df.filter(F.col(column).isNotNull()).groupBy(
        F.length(column).cast("bigint").alias("length")
    ).agg(F.count(F.lit(1)).alias("count"))


def build_profile(
    df: DataFrame, categories: str = "company_size", nulls: str = "state", texts: str = "description"
) -> DataFrame:
    """(metric, bucket, count) with metrics ``category``, ``nulls``, ``length``: one scan, one shuffle."""
    cells = F.explode(F.array(
        F.struct(F.lit("category").alias("metric"), bucket_of(F.col(categories)).alias("bucket")),
        F.struct(F.lit("nulls").alias("metric"), null_bucket(F.col(nulls)).alias("bucket")),
        F.struct(F.lit("length").alias("metric"), F.length(texts).cast("string").alias("bucket")),
    ))
    return df.select(cells.alias("c")).select("c.*").filter(F.col("bucket").isNotNull()).groupBy(
        "metric", "bucket"
    ).agg(F.count(F.lit(1)).alias("count"))


def psi_severity(psi: Column) -> Column:
    return F.when(psi >= PSI_SIGNIFICANT, "significant").when(psi >= PSI_MODERATE, "moderate").otherwise("none")


def ks_severity(p: Column) -> Column:
    return F.when(p < KS_SIGNIFICANT, "significant").when(p < KS_MODERATE, "moderate").otherwise("none")


def psi(baseline: DataFrame, batch: DataFrame, by: str | None = None) -> DataFrame:
    """One row (per ``by``) with the PSI of two (bucket, count) tables; null when a side is empty."""
    group = [by] if by else []

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*group, "bucket", F.col("count").alias(name))

    both = side(baseline, "a").join(side(batch, "b"), [*group, "bucket"], "full").na.fill(0, ["a", "b"])
    if not by:
        both = both.withColumn("__g", F.lit(0))
    g = by or "__g"
    totals = both.groupBy(g).agg(
        F.nullif(F.sum("a"), F.lit(0)).alias("ta"), F.nullif(F.sum("b"), F.lit(0)).alias("tb")
    )
    # one row per metric, so always small
    shares = both.join(F.broadcast(totals), g).select(
        g,
        F.when(F.col("ta").isNotNull(), F.greatest(F.col("a") / F.col("ta"), F.lit(FLOOR))).alias("pa"),
        F.when(F.col("tb").isNotNull(), F.greatest(F.col("b") / F.col("tb"), F.lit(FLOOR))).alias("pb"),
    )
    term = (F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa"))
    out = shares.groupBy(g).agg(F.sum(term).alias("psi"))
    return out.withColumn("severity", psi_severity(F.col("psi"))).select(*group, "psi", "severity")


def ks(baseline: DataFrame, batch: DataFrame, value: str) -> DataFrame:
    """statistic, p_value, severity, n1, n2 of two (value, count) histograms."""
    def side(df: DataFrame, a: Column, b: Column) -> DataFrame:
        return df.select(F.col(value).alias("value"), a.alias("a"), b.alias("b"))

    zero = F.lit(0).cast("bigint")
    merged = side(baseline, F.col("count"), zero).unionByName(side(batch, zero, F.col("count")))
    steps = merged.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    curve = running_sums(steps, "value", ["a", "b"])
    gap = F.abs(F.col("cum_a") / F.nullif(F.col("total_a"), F.lit(0)) - F.col("cum_b") / F.nullif(F.col("total_b"), F.lit(0)))
    top = curve.agg(
        F.max(gap).alias("statistic"), F.max("total_a").alias("n1"), F.max("total_b").alias("n2")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    return top.withColumn("p_value", kolmogorov_p(F.col("statistic"), n1, n2)).withColumn(
        "severity", ks_severity(F.col("p_value"))
    )


def ks_of_values(baseline: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """KS straight from two tables: histograms first, then the curve."""
    def hist(df: DataFrame) -> DataFrame:
        return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))

    return ks(hist(baseline), hist(batch), column)


def check_drift(profile: DataFrame, batch: DataFrame) -> DataFrame:
    """Report of two profiles: metric, kind, value, p_value, severity, any_flagged.

    Profiles and the three report rows are written once, so each input is read once.
    """
    profile, batch = pin(profile, "profile"), pin(batch, "profile")
    def part(df: DataFrame, metric: str) -> DataFrame:
        return df.filter(F.col("metric") == metric)

    categorical = F.col("metric") != "length"
    psis = psi(profile.filter(categorical), batch.filter(categorical), by="metric").select(
        F.when(F.col("metric") == "category", "company_size").otherwise("state_null_rate").alias("metric"),
        F.lit("psi").alias("kind"), F.col("psi").alias("value"), F.lit(None).cast("double").alias("p_value"), "severity",
    )

    def lengths(df: DataFrame) -> DataFrame:
        return part(df, "length").select(F.col("bucket").cast("bigint").alias("length"), "count")

    lens = ks(lengths(profile), lengths(batch), "length").select(
        F.lit("description_len").alias("metric"), F.lit("ks").alias("kind"),
        F.col("statistic").alias("value"), "p_value", "severity",
    )
    report = pin(psis.unionByName(lens), "drift")
    flagged = report.agg(F.bool_or(F.col("severity") != "none").alias("any_flagged"))
    return report.join(F.broadcast(flagged.withColumn("__g", F.lit(0))), F.lit(0) == F.col("__g")).drop("__g")


def drift_status(report: DataFrame) -> DataFrame:
    """Report ordered by magnitude, largest first."""
    return report.orderBy(F.col("value").desc(), "metric")


def draw_batches(
    df: DataFrame, key: str, baseline: int = BASELINE_ROWS, batch: int = BATCH_ROWS, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(baseline, batch): two exact, disjoint samples by hash of the key (all rows, then none, when there are fewer)."""
    first = pin(sample_exact_n(df, key, baseline, seed), "baseline")
    rest = df.join(first.select(key), key, "left_anti").select(*df.columns)
    return first, sample_exact_n(rest, key, batch, seed + 1)


def save_report(report: DataFrame, path: str) -> None:
    """Write the report of ``check_drift``; ``load_profile`` reads either table."""
    report.write.mode("overwrite").parquet(path)


def save_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").parquet(path)


def load_profile(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
