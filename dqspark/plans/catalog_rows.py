"""Queries over rows: contract, cleaning, sinks, run report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators import clean, contract, impute
from dqspark.operators.contract import COMPANY, REASONS_TYPE, Contract, Field
from dqspark.plans import companies as co
from dqspark.plans import run
from dqspark.plans.run import stage_counts
from dqspark.plans.sqltext import BUSINESS, normalize, sql
from dqspark.sources.durable import pin, shared_folder
from dqspark.sources.ledger import Ledger
from dqspark.sources.sinks import quarantine_records, upsert_absent

LOOSE = Contract(
    (
        Field("company_id", "str", required=True), Field("name"), Field("description"),
        Field("company_size"), Field("state"), Field("country"), Field("city"),
        Field("zip_code"), Field("address"), Field("url"),
    ),
    key="company_id",
)


def contract_validate(spark: SparkSession, sf: str) -> DataFrame:
    return co.annotated(spark, sf).select(
        F.col("_seq").alias("seq"), (F.size("reasons") == 0).alias("valid"),
        "record.company_id", "record.company_size", "record.state", "record.country",
    )


def contract_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return contract.explode_reasons(co.annotated(spark, sf)).withColumnRenamed("_seq", "seq")


def contract_split(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.size("reasons") == 0, "valid").otherwise("invalid")
    return co.annotated(spark, sf).groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("reasons")).alias("reasons"),
        F.min("_seq").alias("first_seq"), F.max("_seq").alias("last_seq"),
    )


def violation_count(spark: SparkSession, sf: str) -> DataFrame:
    return contract.violation_count(co.feed(spark, sf)).select(F.col("_seq").alias("seq"), "violations")


def sentinel_to_null(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), contract.sentinel_to_null(F.col(c), ("0",)).alias("value"))
        for c in ("state", "country")
    ]))
    return co.feed(spark, sf, "state", "country").select(cells.alias("c")).groupBy("c.column", "c.value").agg(
        F.count(F.lit(1)).alias("rows")
    )


def contract_compare(spark: SparkSession, sf: str) -> DataFrame:
    rates = contract.pass_rates(co.feed(spark, sf), {"company": COMPANY, "loose": LOOSE})
    return rates.withColumn("pass_rate", F.round("pass_rate", 6))


def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return clean.remove_exact_duplicates(co.valid(spark, sf)).withColumnRenamed("_seq", "seq")


def dedup_count(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_report(co.feed(spark, sf))


def coerce_types(spark: SparkSession, sf: str) -> DataFrame:
    casts = {"company_id": "bigint", "company_size": "bigint", "zip_code": "double", "absent": "int"}
    return clean.coerce_types(co.feed(spark, sf), casts).select(
        F.col("_seq").alias("seq"), "company_id", "company_size", "zip_code"
    )


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.normalize_text_columns(co.feed(spark, sf), list(COMPANY.text_columns))
    return rows.select(F.col("_seq").alias("seq"), *COMPANY.text_columns)


def clean_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return co.cleaned(spark, sf).withColumnRenamed("_seq", "seq")


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    existing = co.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("company_id"))
    return upsert_absent(existing, pin(co.cleaned(spark, sf), "cleaned"), "company_id").withColumnRenamed("_seq", "seq")


def insert_with_history(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches into one ledger: the row that holds each key and the run that wrote it."""
    rows = pin(co.cleaned(spark, sf).select("_seq", "_seq", "company_id").toDF("_seq", "seq", "company_id"), "cleaned")
    rejected = spark.createDataFrame([], "raw string, reasons " + REASONS_TYPE)
    book = Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    book.write(rows.filter("seq % 3 <> 0"), rejected)
    book.write(rows, rejected)
    return book.clean().join(F.broadcast(book.runs().select("run", "number")), "run").select("company_id", "seq", "number")


def quarantine_rows(spark: SparkSession, sf: str) -> DataFrame:
    rejected = contract.invalid_rows(co.annotated(spark, sf))
    records = quarantine_records(rejected)
    field = {c: F.get_json_object("raw_data", f"$.{c}") for c in ("company_id", "name", "url", "zip_code")}
    return records.select(
        *[v.alias(k) for k, v in field.items()],
        F.get_json_object("raw_data", "$.company_size").alias("company_size"),
        F.size(F.json_object_keys("raw_data")).cast("bigint").alias("keys"),
        F.size("reasons").cast("bigint").alias("reasons"),
    )


def pipeline_report(spark: SparkSession, sf: str) -> DataFrame:
    return stage_counts(co.annotated(spark, sf))


def run_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A whole batch into new tables: every row that came in is counted once."""
    folder = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    plain = {"company_size": [impute.Baseline("median")], "country": [impute.Baseline("mode")]}
    report = run.run_batch(co.feed(spark, sf), f"{folder}/clean", f"{folder}/quarantine", strategies=plain)
    names = ("ingested", "written_clean", "written_quarantine", "duplicates_removed", "key_conflict")
    return spark.createDataFrame([tuple(int(report[n]) for n in names)], ", ".join(f"{n} bigint" for n in names))


QUERIES = {
    "contract_validate": contract_validate,
    "contract_reasons": contract_reasons,
    "contract_split": contract_split,
    "violation_count": violation_count,
    "sentinel_to_null": sentinel_to_null,
    "contract_compare": contract_compare,
    "exact_dedup": exact_dedup,
    "dedup_count": dedup_count,
    "coerce_types": coerce_types,
    "text_normalize": text_normalize,
    "clean_pipeline": clean_pipeline,
    "upsert_absent": upsert,
    "insert_with_history": insert_with_history,
    "quarantine_rows": quarantine_rows,
    "pipeline_report": pipeline_report,
    "run_batch": run_batch,
}

_FAILS = "(CASE WHEN e_id IS NULL THEN 0 ELSE 1 END + CASE WHEN e_size IS NULL THEN 0 ELSE 1 END + CASE WHEN e_url IS NULL THEN 0 ELSE 1 END)"

ORACLE = {
    "contract_validate": sql(
        f"""SELECT _seq AS seq, {_FAILS} = 0 AS valid, TRY_CAST(company_id AS BIGINT) AS company_id,
        TRY_CAST(company_size AS BIGINT) AS company_size,
        CASE WHEN trim(state) = '0' THEN NULL ELSE state END AS state,
        CASE WHEN trim(country) = '0' THEN NULL ELSE country END AS country FROM chk""", "chk"),
    "contract_reasons": sql(
        """SELECT _seq AS seq, 'company_id' AS rule, e_id AS message, 'error' AS severity FROM chk WHERE e_id IS NOT NULL
        UNION ALL SELECT _seq, 'company_size', e_size, 'error' FROM chk WHERE e_size IS NOT NULL
        UNION ALL SELECT _seq, 'url', e_url, 'error' FROM chk WHERE e_url IS NOT NULL""", "chk"),
    "contract_split": sql(
        f"""SELECT CASE WHEN {_FAILS} = 0 THEN 'valid' ELSE 'invalid' END AS side, count(*) AS rows,
        CAST(sum({_FAILS}) AS BIGINT) AS reasons, min(_seq) AS first_seq, max(_seq) AS last_seq
        FROM chk GROUP BY 1""", "chk"),
    "violation_count": sql(f"SELECT _seq AS seq, CAST({_FAILS} AS BIGINT) AS violations FROM chk", "chk"),
    "sentinel_to_null": sql(
        """SELECT "column", CASE WHEN trim(value) = '0' THEN NULL ELSE value END AS value, count(*) AS rows FROM (
        SELECT 'state' AS "column", state AS value FROM fx UNION ALL SELECT 'country', country FROM fx)
        GROUP BY ALL""", "fx"),
    "contract_compare": sql(
        f"""SELECT contract, total, passed, total - passed AS failed, round(passed / total, 6) AS pass_rate FROM (
        SELECT 'company' AS contract, count(*) AS total, count(*) FILTER ({_FAILS} = 0) AS passed FROM chk
        UNION ALL SELECT 'loose', count(*), count(company_id) FROM chk)""", "chk"),
    "exact_dedup": sql(f"SELECT _seq AS seq, {BUSINESS} FROM ded", "ded"),
    "dedup_count": sql(
        f"""SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS removed
        FROM (SELECT count(*) AS n FROM fx GROUP BY {BUSINESS})""", "fx"),
    "coerce_types": sql(
        """SELECT _seq AS seq, TRY_CAST(company_id AS BIGINT) AS company_id,
        TRY_CAST(company_size AS BIGINT) AS company_size, TRY_CAST(zip_code AS DOUBLE) AS zip_code FROM fx""", "fx"),
    "text_normalize": sql(
        "SELECT _seq AS seq, " + ", ".join(f"{normalize(c)} AS {c}" for c in COMPANY.text_columns) + " FROM fx", "fx"),
    "clean_pipeline": sql(f"SELECT _seq AS seq, {BUSINESS} FROM cln"),
    "upsert_absent": sql(
        f"""SELECT _seq AS seq, {BUSINESS} FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY _seq) AS rn FROM cln
        WHERE company_id NOT IN (SELECT s_suppkey FROM supplier)) WHERE rn = 1"""),
    "insert_with_history": sql(
        """SELECT company_id, coalesce(min(_seq) FILTER (_seq % 3 <> 0), min(_seq)) AS seq,
        CAST(CASE WHEN count(*) FILTER (_seq % 3 <> 0) > 0 THEN 1 ELSE 2 END AS BIGINT) AS number FROM cln GROUP BY company_id"""),
    "quarantine_rows": sql(
        f"""SELECT company_id, name, url, zip_code, company_size, CAST(10 AS BIGINT) AS keys,
        CAST({_FAILS} AS BIGINT) AS reasons FROM chk WHERE {_FAILS} > 0""", "chk"),
    "pipeline_report": sql(
        """SELECT ingested, passed, ingested - passed AS failed_contract, passed - cleaned AS duplicates_removed,
        written_clean, cleaned - written_clean AS key_conflict, ingested - passed AS written_quarantine FROM (
        SELECT (SELECT count(*) FROM fx) AS ingested, (SELECT count(*) FROM rec) AS passed,
        (SELECT count(*) FROM cln) AS cleaned, (SELECT count(DISTINCT company_id) FROM cln) AS written_clean)"""),
    "run_batch": sql(
        """SELECT (SELECT count(*) FROM fx) AS ingested, (SELECT count(DISTINCT company_id) FROM cln) AS written_clean,
        (SELECT count(*) FROM fx) - (SELECT count(*) FROM rec) AS written_quarantine,
        (SELECT count(*) FROM rec) - (SELECT count(*) FROM cln) AS duplicates_removed,
        (SELECT count(*) FROM cln) - (SELECT count(DISTINCT company_id) FROM cln) AS key_conflict"""),
}
