"""Append-only result tables: clean rows, quarantine records, reviews, metrics, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators.contract import REASONS_TYPE, SEQ
from dqspark.operators.review import DECISIONS
from dqspark.sources.durable import pin
from dqspark.sources.files import _exists

REVIEW = "record_id bigint, decision string, reviewed_at timestamp"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table, or None before its first write."""
    return spark.read.parquet(path) if _exists(spark, path) else None


def first_per_key(df: DataFrame, key: str, seq: str = SEQ) -> DataFrame:
    """First row of each key in ingest order; ``seq`` is unique within a key, keys are not null.

    Only keys and places are grouped, so no task sorts whole rows.  ``df`` is read
    twice: hand over a written table.
    """
    first = df.groupBy(key).agg(F.min(seq).alias(seq))
    return df.join(first, [key, seq], "left_semi").select(*df.columns)


def upsert_absent(existing: DataFrame | None, incoming: DataFrame, key: str, seq: str = SEQ) -> DataFrame:
    """Rows to append: first per key in the batch, and no row whose key is already there."""
    first = first_per_key(incoming, key, seq)
    return first if existing is None else first.join(existing.select(key), key, "left_anti").select(*first.columns)


def write_clean(records: DataFrame, path: str, key: str = "company_id", small: tuple[str, ...] = ("company_size",)) -> int:
    """Insert if the key is absent; returns rows written.  A second run writes none."""
    spark = records.sparkSession
    if SEQ not in records.columns:
        records = records.withColumn(SEQ, F.monotonically_increasing_id())
    new = upsert_absent(read_table(spark, path), pin(records, "records"), key).drop(SEQ)
    new = new.withColumns({c: F.col(c).cast("smallint") for c in small if c in new.columns})
    batch = pin(new.withColumn("loaded_at", F.current_timestamp()), "clean")
    written = batch.count()
    if written:
        batch.write.mode("append").parquet(path)
    return written


def raw_json(raw: Column) -> Column:
    """JSON of the row as it came, nulls included."""
    return F.to_json(raw, {"ignoreNullFields": "false"})


def quarantine_records(rejected: DataFrame, first_id: int = 1) -> DataFrame:
    """(id, raw_data, reasons, quarantined_at) of rows with ``raw`` (struct or JSON text) and ``reasons``."""
    is_text = dict(rejected.dtypes)["raw"] == "string"
    return rejected.select(
        (F.monotonically_increasing_id() + first_id).alias("id"),
        (F.col("raw") if is_text else raw_json(F.col("raw"))).alias("raw_data"),
        F.col("reasons").cast(REASONS_TYPE).alias("reasons"),
        F.current_timestamp().alias("quarantined_at"),
    )


def write_quarantine(rejected: DataFrame, path: str) -> int:
    """Append every rejected row with all its reasons; returns rows written."""
    spark = rejected.sparkSession
    existing = read_table(spark, path)
    last = existing.agg(F.max("id")).first()[0] if existing is not None else None
    batch = pin(quarantine_records(rejected, (last or 0) + 1), "quarantine")
    written = batch.count()
    if written:
        batch.write.mode("append").parquet(path)
    return written


def new_reviews(existing: DataFrame | None, submitted: DataFrame) -> DataFrame:
    """Submitted reviews that count: valid decision, first per record, record not reviewed yet."""
    valid = submitted.filter(F.col("decision").isin(*DECISIONS))
    # two decisions may carry one time: any one of them counts
    return upsert_absent(existing, valid, "record_id", "reviewed_at").dropDuplicates(["record_id"])


def submit_review(spark: SparkSession, path: str, record_id: int, decision: str) -> bool:
    """Record one decision; False when the record already has one."""
    if decision not in DECISIONS:
        raise ValueError(f"decision must be one of {', '.join(DECISIONS)}")
    one = spark.range(1).select(
        F.lit(record_id).cast("bigint").alias("record_id"), F.lit(decision).alias("decision"),
        F.current_timestamp().alias("reviewed_at"),
    )
    batch = pin(new_reviews(read_table(spark, path), one), "review")
    if batch.isEmpty():
        return False
    batch.write.mode("append").parquet(path)
    return True


def append_run(spark: SparkSession, path: str, experiment: str, params: dict, metrics: dict) -> None:
    """One run of an experiment with its parameters and metrics."""
    spark.createDataFrame(
        [(experiment, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})],
        "experiment string, params map<string,string>, metrics map<string,double>",
    ).withColumn("started_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def register_version(spark: SparkSession, path: str, model: str, winner: str) -> tuple[str, bool]:
    """Append a version row when the winner differs from the latest one's."""
    from dqspark.operators.report import next_version

    known = read_table(spark, path)
    if known is None:
        known = spark.createDataFrame([], "model string, version string, winner string")
    version, is_new = next_version(known, model, winner)
    if is_new:
        spark.createDataFrame([(model, version, winner)], "model string, version string, winner string").coalesce(
            1
        ).write.mode("append").parquet(path)
    return version, is_new
