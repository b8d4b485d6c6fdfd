"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the shared folder and reads it again as the next stage's documents.  All but
the last keep the columns they are given, whatever further columns there are.  Stages take
the columns ``doc_id, text, lang, source``; null ids and texts pass as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import decontaminate, mixing, neardup, pii, quality
from dqspark.llm import labels as labelling
from dqspark.llm.common import pin, table, text_of, words


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the compression classifier does not reject; it learns from the given documents' labels."""
    model = quality.fit(labelling.labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", 5, 0))
    return docs.filter(model.score(text_of("text")) >= quality.THRESHOLD)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; repeated rows of an id leave one."""
    judged = pin(neardup.near_duplicates(docs), "judged")
    kept = judged.filter("kept and doc_id is not null").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    if not judged.groupBy("doc_id").count().filter("doc_id is not null and count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionAll(docs.filter(F.col("doc_id").isNull()))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.select(F.col("text_hash").alias("_leak_hash")).distinct()
    return docs.join(leaks, F.xxhash64(text_of("text")) == F.col("_leak_hash"), "left_anti").select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    out = docs.withColumn("text", pii.mask_column(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the amounts the budgets ask for, with ``epoch`` and ``taken`` tokens.

    Where a budget ends inside a document, its text is the first ``taken`` words with single
    spaces.  Rows that repeat an id are one document here; rows without an id are one each.
    """
    own = [c for c in docs.columns if c not in ("epoch", "taken")]
    rows = docs.select(*own).withColumn("_mix_row", F.lit(None).cast("long"))
    if not docs.filter("doc_id is null").isEmpty():  # numbered once and written, so that the numbers stay
        loose = docs.filter("doc_id is null").select(*own, F.monotonically_increasing_id().alias("_mix_row"))
        rows = rows.filter("doc_id is not null").unionAll(pin(loose, "rows-without-id"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("_mix_row").cast("string")))
    taken = mixing.mix(rows, carry=("_mix_row",)).select(
        key.alias("_mix_key"), F.col("tokens").alias("_mix_tokens"), "epoch", "taken"
    ).distinct()
    found = words(text_of("text"))
    joined = rows.withColumn("_mix_own", key).join(
        taken, (F.col("_mix_own") == F.col("_mix_key")) & (F.size(found) == F.col("_mix_tokens"))
    )
    cut = F.when(F.col("taken") < F.col("_mix_tokens"), F.array_join(F.slice(found, 1, F.col("taken").cast("int")), " "))
    return joined.withColumn("text", F.coalesce(cut, F.col("text"))).select(*own, "epoch", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("neardup", keep_distinct),
    ("decontaminate", drop_leaks),
    ("pii", mask_pii),
    ("mixing", mix_sources),
]

#: The first and second stage are learned and probabilistic, so SQL cannot state run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
