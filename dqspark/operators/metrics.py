"""Classification metrics as aggregates; every shuffle moves counts, not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.operators.ranking import running_sums


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def per_class_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, predicted count, true positives, f1 over true and predicted labels."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(zero)
    sides = F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("t"), zero.alias("p"), hit.alias("tp")),
        F.struct(F.col(predicted).alias("label"), zero.alias("t"), F.col("n").alias("p"), zero.alias("tp")),
    ))
    per_label = (
        cells.select(sides.alias("s")).select("s.*").filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("hits"))
    )
    return per_label.withColumn("f1", ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted")))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: plain mean of per-class F1 over the union of labels."""
    return per_class_f1(df, truth, predicted).agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes")
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """One row per true label, one column per predicted label, zeros filled in."""
    return (
        df.groupBy(truth).pivot(predicted, sorted(labels)).agg(F.count(F.lit(1)))
        .na.fill(0).orderBy(truth)
    )


def misclassified(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows whose prediction is not the true label."""
    return df.filter(~F.col(truth).eqNullSafe(F.col(predicted)))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over distinct scores of recall gain times precision; equal scores are one step."""
    steps = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    curve = running_sums(steps, "score", ["pos", "n"], descending=True)
    gain = F.col("pos") / F.nullif(F.col("total_pos"), F.lit(0)) * (F.col("cum_pos") / F.col("cum_n"))
    return curve.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision"))


def _confusion_counts(flag: Column, label: Column) -> list[Column]:
    return [
        F.coalesce(F.count_if(flag & (label == 1)), F.lit(0)).alias("tp"),
        F.coalesce(F.count_if(flag & (label == 0)), F.lit(0)).alias("fp"),
        F.coalesce(F.count_if(~flag & (label == 1)), F.lit(0)).alias("fn"),
    ]


def _rates() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
    ]


def binary_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall and F1 of ``score >= threshold``."""
    flag = F.col(score) >= threshold
    return df.agg(F.count(F.lit(1)).alias("n"), *_confusion_counts(flag, F.col(label))).select(
        "n", "tp", "fp", "fn", *_rates()
    )


def clean_fpr(df: DataFrame, score: str, kind: str, threshold: float = 0.5, clean: str = "clean") -> DataFrame:
    """Share of clean rows that would be flagged."""
    rows = df.filter(F.col(kind) == clean)
    return rows.agg(
        F.count(F.lit(1)).alias("n_clean"), F.count_if(F.col(score) >= threshold).alias("n_flagged")
    ).withColumn("clean_fpr", ratio(F.col("n_flagged"), F.col("n_clean")))


def per_type_metrics(
    df: DataFrame, score: str, label: str, kind: str, threshold: float = 0.5, clean: str = "clean"
) -> DataFrame:
    """Each type against all clean rows, other types left out.

    Counted once per (type, cell); the clean counts are one row joined to the
    few types, so clean rows are never repeated per type.
    """
    flag = F.col(score) >= threshold
    counts = df.groupBy(F.col(kind).alias("kind")).agg(*_confusion_counts(flag, F.col(label)))
    base = counts.filter(F.col("kind") == clean).select(
        F.lit(0).alias("__g"), F.col("tp").alias("c_tp"), F.col("fp").alias("c_fp"), F.col("fn").alias("c_fn")
    )
    joined = (
        counts.filter(F.col("kind") != clean).withColumn("__g", F.lit(0))
        .join(F.broadcast(base), "__g", "left").na.fill(0)
    )
    return joined.select(
        "kind",
        (F.col("tp") + F.col("c_tp")).alias("tp"),
        (F.col("fp") + F.col("c_fp")).alias("fp"),
        (F.col("fn") + F.col("c_fn")).alias("fn"),
    ).select("kind", (F.col("tp") + F.col("fn")).alias("n"), *_rates())
