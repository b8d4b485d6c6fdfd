"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import labels as labelling
from dqspark.llm import (
    decontaminate, htmlmain, language, licenses, linerules, mixing, neardup, periods, pii, quality, suffixes, toxicity, whitening,
)
from dqspark.llm.common import fold, table, text_of


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under repeated strings of 200 bytes, removed from every document."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression classifier: learned outside fold 0 of 5, applied to every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(labelling.labelled_texts(docs, labels, "quality", 5, 0))
    return docs.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), model.score(text_of("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op4_htmlmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmlmain.main_texts(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_linerules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and line frequency of every document."""
    return linerules.judge(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factorization machine: learned outside fold 2 of 4, applied to every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(labelling.labelled_texts(docs, labels, "toxic", 4, 2))
    return docs.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), model.score(text_of("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs taken to meet the budgets of all leaves."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, taken as files of source and language directories."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.document_path(), carry=("doc_id",)).drop("path")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, a tenth of the documents made periodic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.planted().alias("text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return periods.find_runs(docs).withColumn("best", periods.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold("doc_id", 4) != 2)
    return docs.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), model.label_column(text_of("text")).alias("found")
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


QUERIES = {
    "op1_neardup": op1_neardup, "op2_quality": op2_quality, "op3_suffixes": op3_suffixes, "op4_htmlmain": op4_htmlmain,
    "op5_decontaminate": op5_decontaminate, "op6_linerules": op6_linerules,
    "op7_toxicity": op7_toxicity, "op8_mixing": op8_mixing, "op9_licenses": op9_licenses, "op10_pii": op10_pii,
    "op11_whitening": op11_whitening, "op12_periods": op12_periods,
    "op13_language": op13_language,
}
ORACLE = {
    "op5_decontaminate": decontaminate.ORACLE, "op6_linerules": linerules.ORACLE, "op8_mixing": mixing.ORACLE,
    "op9_licenses": licenses.ORACLE,
}
