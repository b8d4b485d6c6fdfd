"""The company feed: a 10-column text table derived from the given tables.

The given tables are clean, so missing, malformed and repeated rows are derived
from keys by fixed arithmetic.  One SQL text serves Spark and DuckDB.  The hint
keeps the table with the long texts from being broadcast: its size says little
about its compressed files, and the shuffle spreads the text work over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions import chars
from dqspark.operators import clean, contract

COPY_OFFSET = 1_000_000_000_000

FEED_SQL = f"""
SELECT /*+ MERGE(d) */
  k + copy_of * CAST({COPY_OFFSET} AS BIGINT) AS _seq,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 67 = 0 THEN 'abc'
       WHEN k % 71 = 0 THEN CAST(k - 1 AS STRING) ELSE CAST(k AS STRING) END AS company_id,
  CASE WHEN k % 10 = 0 THEN '  ' || c_name || '   Corp ' ELSE c_name END AS name,
  d.text AS description,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 53 = 0 THEN '99'
       ELSE CAST(1 + (k * 7 + nk) % 7 AS STRING) END AS company_size,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN '0'
       ELSE substr('NYCATXFLILWAMAPAOHGA', CAST(1 + 2 * (nk % 10) AS INT), 2) END AS state,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '0'
       WHEN rk <= 2 THEN 'US' WHEN rk = 3 THEN 'GB' ELSE 'DE' END AS country,
  CASE WHEN k % 15 = 0 THEN NULL ELSE 'City ' || CAST(nk AS STRING) END AS city,
  CASE WHEN k % 14 = 0 THEN NULL ELSE
    CAST(100 + 10 * ((nk + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END) % 10) + k % 5 AS STRING)
    || lpad(CAST(k % 100 AS STRING), 2, '0') END AS zip_code,
  CASE WHEN k % 21 = 0 THEN NULL ELSE CAST(k % 50 AS STRING) || ' Main St' END AS address,
  CASE WHEN k % 97 = 0 THEN 'not-a-valid-url'
       ELSE coalesce(p.url, 'https://www.example.com/c/' || CAST(k AS STRING)) END AS url
FROM (
  SELECT c_custkey AS k, c_name, c_nationkey, 0 AS copy_of FROM {{customer}}
  UNION ALL
  SELECT c_custkey AS k, c_name, c_nationkey, 1 AS copy_of FROM {{customer}} WHERE c_custkey % 40 = 0
) c
JOIN (SELECT n_nationkey AS nk, n_regionkey AS rk FROM {{nation}}) n ON c.c_nationkey = n.nk
LEFT JOIN {{documents}} d ON d.doc_id = c.k
LEFT JOIN {{pages}} p ON p.page_id = c.k
"""
#: What a column needs beyond customer and nation: its table, its join, and what stands for it without the join.
OPTIONAL_JOINS = {
    "description": ("documents", "LEFT JOIN {documents} d ON d.doc_id = c.k", "d.text", "CAST(NULL AS STRING)"),
    "url": ("pages", "LEFT JOIN {pages} p ON p.page_id = c.k", "p.url", "CAST(NULL AS STRING)"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str, *columns: str, **instead_of: DataFrame) -> DataFrame:
    """The raw feed: ``_seq`` and ten text columns, or the given ones without the joins they do not need.

    ``instead_of`` names tables to take in place of the stored ones.
    """
    text, names = FEED_SQL, ["customer", "nation"]
    for column, (name, join, value, instead) in OPTIONAL_JOINS.items():
        if columns and column not in columns:
            text = text.replace(join, "").replace(value, instead)
        else:
            names.append(name)
    if "{documents}" not in text:
        text = text.replace("/*+ MERGE(d) */", "")
    rows = spark.sql(text, **{n: instead_of[n] if n in instead_of else table(spark, sf_dir, n) for n in names})
    return rows.select(*columns) if columns else rows


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.annotate(feed(spark, sf_dir))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.valid_records(annotated(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, deduplicated, normalized records with ``_seq``."""
    return clean.clean_records(valid(spark, sf_dir))


def brief(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The asked columns of ``cleaned``; no description leaves its documents row as a text.

    Joins and duplicates need only its equalities, so a SHA-256 of the text stands for it.  The
    description asked for is that of the cleaned text, with the same nulls and equalities.
    """
    text, asked = F.col("text"), "description" in columns
    mark = F.sha2(text, 256)
    if asked:
        mark = F.when(text.isNotNull(), F.concat_ws(" ", mark, F.sha2(chars.tidy(text), 256)))
    documents = table(spark, sf_dir, "documents").select("doc_id", mark.alias("text"))
    valid_rows = contract.valid_records(contract.annotate(feed(spark, sf_dir, documents=documents)))
    rows = clean.clean_records(valid_rows)
    if asked:
        rows = rows.withColumn("description", F.nullif(F.substring("description", 66, 64), F.lit("")))
    return rows.select(*columns)
