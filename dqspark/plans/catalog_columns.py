"""Queries over columns: fingerprints, semantic types, inferred contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions import text as tx
from dqspark.operators import coltype, contract, fingerprint, infer, metrics, ranking
from dqspark.operators.contract import COMPANY
from dqspark.operators.fpstate import FingerprintStore
from dqspark.plans import companies as co
from dqspark.plans.sqltext import count_of, matches, quote, sql, strip
from dqspark.sources.durable import pin, shared_folder

# the true type of each column of the given tables, as read by a person
COLUMN_LABELS = {
    "feed": {
        "company_id": "identifier", "name": "free_text", "description": "free_text",
        "company_size": "categorical", "state": "geographic", "country": "geographic",
        "city": "geographic", "zip_code": "geographic", "address": "geographic", "url": "url",
    },
    "part": {
        "p_partkey": "identifier", "p_name": "free_text", "p_brand": "categorical",
        "p_type": "categorical", "p_size": "numeric_continuous", "p_retailprice": "numeric_continuous",
    },
    "orders": {
        "o_orderkey": "identifier", "o_custkey": "identifier", "o_orderstatus": "categorical",
        "o_totalprice": "numeric_continuous", "o_orderdate": "date", "o_orderpriority": "categorical",
    },
    "lineitem": {
        "l_orderkey": "identifier", "l_partkey": "identifier", "l_suppkey": "identifier", "l_linenumber": "categorical", "l_quantity": "numeric_continuous",
        "l_extendedprice": "numeric_continuous", "l_discount": "numeric_continuous",
        "l_tax": "numeric_continuous", "l_returnflag": "categorical",
        "l_linestatus": "categorical", "l_shipdate": "date",
    },
    "customer": {
        "c_custkey": "identifier", "c_name": "identifier", "c_acctbal": "numeric_continuous",
        "c_mktsegment": "categorical",
    },
    "supplier": {"s_suppkey": "identifier", "s_name": "identifier", "s_acctbal": "numeric_continuous"},
    "nation": {"n_nationkey": "identifier", "n_name": "geographic", "n_regionkey": "categorical"},
    "region": {"r_regionkey": "identifier", "r_name": "geographic"},
    "events": {
        "event_id": "identifier", "ts": "date", "user_id": "identifier", "event_type": "categorical",
        "value": "numeric_continuous", "props": "free_text",
    },
    "documents": {
        "doc_id": "identifier", "text": "free_text", "lang": "categorical", "source": "categorical", "n_chars": "numeric_continuous",
    },
    "labels": {"doc_id": "identifier", "quality": "boolean", "toxic": "boolean"},
    "pages": {"page_id": "identifier", "url": "url", "html": "free_text"},
    "conversations": {"conv_id": "identifier", "turn": "numeric_continuous", "role": "categorical", "text": "free_text"},
    "benchmark": {"item_id": "identifier", "text": "free_text"},
    "embeddings": {"vec_id": "identifier", "label": "categorical"},
}

# declared types of the feed's columns, as a prediction would give them
FEED_TYPES = {
    "company_id": ("identifier", 0.95), "name": ("free_text", 0.85), "description": ("free_text", 0.9),
    "company_size": ("boolean", 0.48), "state": ("geographic", 0.7), "country": ("categorical", 0.8),
    "city": ("geographic", 0.75), "zip_code": ("numeric_continuous", 0.55), "address": ("geographic", 0.65),
    "url": ("url", 0.99),
}
FP_TABLES = ("part", "orders", "pages")


def _tables(spark: SparkSession, sf: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    feed = {"feed": co.feed(spark, sf).drop("_seq")}
    return feed | {n: co.table(spark, sf, n) for n in names}


def column_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    prints = fingerprint.fingerprint_tables(_tables(spark, sf, FP_TABLES))
    return prints.select("source", "column", "n_rows", *[F.round(f, 6).alias(f) for f in fingerprint.FEATURES])


def fingerprint_state(spark: SparkSession, sf: str) -> DataFrame:
    """The same fingerprints from stored states of two batches a table."""
    store = FingerprintStore(spark, f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}")
    tables = _tables(spark, sf, FP_TABLES)
    for name, df in tables.items():
        second = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(2)) == 1
        store.add(name, df.filter(~second))
        store.compact(name)
        store.add(name, df.filter(second))
    return store.fingerprints(*tables).select("source", "column", "n_rows", *[F.round(f, 6).alias(f) for f in fingerprint.FEATURES])


def sample_values(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.sample_values(co.feed(spark, sf), "_seq").withColumn("position", F.col("position").cast("bigint"))


def _labels(spark: SparkSession) -> DataFrame:
    rows = [(t, c, label) for t, columns in COLUMN_LABELS.items() for c, label in columns.items()]
    return spark.createDataFrame(rows, "source string, column string, label string")


def _labeled(spark: SparkSession, sf: str) -> DataFrame:
    others = tuple(t for t in COLUMN_LABELS if t != "feed")
    tables = {
        n: df.select(*[c for c in COLUMN_LABELS[n]]) for n, df in _tables(spark, sf, others).items()
    }
    prints = fingerprint.fingerprint_tables(tables)
    return fingerprint.label_fingerprints(prints, _labels(spark)).withColumn("key", F.concat_ws("/", "source", "column"))


def column_types(spark: SparkSession, sf: str) -> DataFrame:
    """Train on labeled columns, report prediction and distribution of the held-out ones."""
    _, held_out, _ = coltype.evaluate(pin(_labeled(spark, sf), "prints"))
    return held_out


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    known = co.cleaned(spark, sf).filter(F.col("company_size").isNotNull())
    split = ranking.stratified_split(known, "company_size", "_seq", 0.25, 42)
    test = F.col("is_test")
    return split.groupBy("company_size").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(test).alias("test_rows"),
        F.min(F.when(test, F.col("_seq"))).alias("first_test_seq"),
        F.sum(F.when(test, F.col("_seq"))).alias("test_seq_sum"),
    )


def _guessed(spark: SparkSession, sf: str) -> DataFrame:
    known = co.cleaned(spark, sf).filter(F.col("company_size").isNotNull())
    return known.select("_seq", "company_size", ((F.col("company_size") + F.col("_seq")) % 7 + 1).alias("predicted"))


def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro_f1(_guessed(spark, sf), "company_size", "predicted").withColumn("macro_f1", F.round("macro_f1", 9))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_guessed(spark, sf), "company_size", "predicted", list(range(1, 8)))


def misclassified(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.misclassified(_guessed(spark, sf), "company_size", "predicted").withColumnRenamed("_seq", "seq")


def contract_profile(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name, df in _tables(spark, sf, FP_TABLES).items():
        p = infer.profile(df)
        numbers = [F.round(c, 6).alias(c) for c in ("iso_rate", "us_rate", "min_number", "max_number")]
        parts.append(p.select(F.lit(name).alias("source"), *[c for c in p.columns if c not in
                              ("iso_rate", "us_rate", "min_number", "max_number")], *numbers))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def observed_values(spark: SparkSession, sf: str) -> DataFrame:
    feed = co.feed(spark, sf).drop("_seq")
    listed = infer.observed_values(feed, pin(infer.profile(feed), "profile"))
    return listed.select("column", F.posexplode("observed").alias("position", "value")).withColumn(
        "position", F.col("position").cast("bigint")
    )


def _predictions(spark: SparkSession) -> DataFrame:
    rows = [(c, t, p) for c, (t, p) in FEED_TYPES.items()]
    return spark.createDataFrame(rows, "column string, predicted_type string, confidence double")


def field_specs(spark: SparkSession, sf: str) -> DataFrame:
    feed = co.feed(spark, sf).drop("_seq")
    profiled = pin(infer.profile(feed), "profile")
    specs = infer.field_specs(profiled, infer.observed_values(feed, profiled), _predictions(spark))
    return specs.select(
        "column", "predicted_type", "python_type", "required",
        F.size("constraints").cast("bigint").alias("constraints"),
        F.size("comments").cast("bigint").alias("comments"), F.size("risk_flags").cast("bigint").alias("risk_flags"),
    )


def contract_summary(spark: SparkSession, sf: str) -> DataFrame:
    feed = co.feed(spark, sf).drop("_seq")
    profiled = pin(infer.profile(feed), "profile")
    return infer.summary(infer.field_specs(profiled, infer.observed_values(feed, profiled), _predictions(spark)))


def inferred_contract_passrate(spark: SparkSession, sf: str) -> DataFrame:
    feed = co.feed(spark, sf).drop("_seq")
    inferred, _ = infer.infer_contract(feed, _predictions(spark))
    rates = contract.pass_rates(feed, {"declared": COMPANY, "inferred": inferred})
    return rates.withColumn("pass_rate", F.round("pass_rate", 6))


QUERIES = {
    "column_fingerprint": column_fingerprint,
    "fingerprint_state": fingerprint_state,
    "sample_values": sample_values,
    "stratified_split": stratified_split,
    "macro_f1": macro_f1,
    "confusion_matrix": confusion_matrix,
    "misclassified": misclassified,
    "contract_profile": contract_profile,
    "observed_values": observed_values,
    "field_specs": field_specs,
    "contract_summary": contract_summary,
    "inferred_contract_passrate": inferred_contract_passrate,
    "column_types": column_types,
}

_COLUMNS = {
    "feed": COMPANY.names,
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "pages": ["page_id", "url", "html"],
}
_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS source, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {'fx' if t == 'feed' else t}"
    for t, columns in _COLUMNS.items() for c in columns
)
_TOKENS = f"list_filter(string_split_regex(v, {quote(f'[{tx.SPACE}]+')}), lambda t: t <> '')"
_MEASURED = f"""
SELECT source, "column", v, count(*) AS n, length(v) AS chars,
  {count_of('v', chr(92) + 'p{L}')} AS alpha, {count_of('v', tx.digit_class())} AS digit,
  {count_of('v', f'[{tx.SPACE}]')} AS space, {count_of('v', chr(92) + 'p{Lu}')} AS upper_n,
  len({_TOKENS}) AS tokens,
  coalesce(list_sum(list_transform({_TOKENS}, lambda t: length(t))), 0) AS token_chars,
  coalesce(list_sum(list_transform({_TOKENS}, lambda t: length(t) * length(t))), 0) AS token_squares,
  len(regexp_extract_all(v, {quote(tx.digit_class() + '+')})) AS digit_runs,
  greatest(length(v) - 1, 0) AS pairs,
  CAST({matches('v', tx.EMAIL)} AS INT) AS email, CAST({matches('v', tx.URL_SHAPE_ANY_CASE)} AS INT) AS url,
  CAST({matches('v', tx.DATE_SHAPE)} AS INT) AS date, CAST({matches('v', tx.NUMERIC)} AS INT) AS numeric,
  CAST({matches('v', tx.FLOAT)} AS INT) AS parse
FROM (SELECT source, "column", nullif(value, '') AS v FROM cells) GROUP BY source, "column", v"""


def _w(expr: str) -> str:
    return f"CAST(coalesce(sum(n * {expr}) FILTER (v IS NOT NULL), 0) AS DOUBLE)"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"


def _pstd(sq: str, total: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE sqrt(greatest(0.0, {sq} / {n} - ({total} / {n}) * ({total} / {n}))) END"


_FEATURE_SQL = {
    "null_ratio": "1.0 - vals / n_rows",
    "cardinality_ratio": _div("dist", "vals"),
    "distinct_count_log": "ln(1 + dist)",
    "frac_alpha": _div("alpha", "chars"),
    "frac_digit": _div("digit", "chars"),
    "frac_punct": _div("(chars - alpha - digit - space)", "chars"),
    "frac_space": _div("space", "chars"),
    "frac_upper_of_alpha": _div("upper_n", "alpha"),
    "avg_value_length": _div("chars", "vals"),
    "std_value_length": _pstd("char_squares", "chars", "vals"),
    "avg_token_length": _div("token_chars", "tokens"),
    "std_token_length": _pstd("token_squares", "token_chars", "tokens"),
    "avg_num_tokens": _div("tokens", "vals"),
    "email_hit_rate": _div("email", "vals"),
    "url_hit_rate": _div("url", "vals"),
    "date_hit_rate": _div("date", "vals"),
    "numeric_regex_hit_rate": _div("numeric", "vals"),
    "numeric_parse_rate": _div("parse", "vals"),
    "digit_bigram_rate": _div("(digit - digit_runs)", "pairs"),
}
_SUMMED = ("chars", "alpha", "digit", "space", "upper_n", "tokens", "token_chars", "token_squares",
           "digit_runs", "pairs", "email", "url", "date", "numeric", "parse")
_SUMS = f"""
SELECT source, "column", CAST(sum(n) AS BIGINT) AS n_rows, {_w('1')} AS vals,
  CAST(count(v) AS DOUBLE) AS dist, {_w('chars * chars')} AS char_squares,
  {', '.join(f'{_w(m)} AS {m}' for m in _SUMMED)}
FROM measured GROUP BY source, "column" """

_FLAGS = f"""
SELECT source, "column", v, count(*) AS n,
  {matches('v', tx.INTEGER)} AS is_int,
  lower(v) IN ({', '.join(quote(w) for w in infer.BOOL_WORDS)}) AS is_bool,
  {', '.join(f"lower(v) IN ({', '.join(quote(w) for w in pair)}) AS p{i}" for i, pair in enumerate(infer.WORD_PAIRS))},
  regexp_matches(substr(v, 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(substr(v, 1, 10) AS DATE) IS NOT NULL AS is_iso,
  {matches('v', tx.US_DATE)} AS is_us,
  CASE WHEN {matches('v', tx.FLOAT)} THEN TRY_CAST(v AS DOUBLE) END AS number
FROM (SELECT source, "column", nullif({strip('value')}, '') AS v FROM cells) GROUP BY source, "column", v"""
_PROFILE = """
SELECT source, "column", CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_count,
  CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS value_count,
  count(v) AS distinct_count, coalesce(bool_and(is_int), false) AS all_int,
  coalesce(bool_and(is_int), false) AND count(v) BETWEEN 2 AND 20 AS ordinal_candidate,
  coalesce(bool_and(p0), false) OR coalesce(bool_and(p1), false) OR coalesce(bool_and(p2), false) OR coalesce(bool_and(p3), false) AS boolean_text,
  coalesce(bool_and(is_bool), true) AS bool_parseable,
  coalesce(sum(n) FILTER (is_iso), 0) / sum(n) FILTER (v IS NOT NULL) AS iso_rate,
  coalesce(sum(n) FILTER (is_us), 0) / sum(n) FILTER (v IS NOT NULL) AS us_rate,
  min(number) AS min_number, max(number) AS max_number
FROM flags GROUP BY source, "column" """
_TYPES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS predicted_type, {p} AS confidence" for c, (t, p) in FEED_TYPES.items())
_SPECS = """
SELECT p.*, predicted_type, confidence,
  CASE WHEN predicted_type = 'boolean' AND distinct_count > 2 THEN 'categorical' ELSE predicted_type END AS kind
FROM profile p JOIN types t ON p."column" = t."column" WHERE source = 'feed' """
_FLAG_COUNT = """(confidence < 0.6)::BIGINT + (predicted_type <> kind)::BIGINT
  + (kind = 'identifier' AND null_count > 0)::BIGINT + (kind = 'categorical' AND ordinal_candidate)::BIGINT
  + (kind = 'categorical' AND boolean_text)::BIGINT + (kind = 'date' AND iso_rate < 0.95)::BIGINT
  + (kind = 'boolean')::BIGINT + (kind = 'boolean' AND NOT bool_parseable)::BIGINT"""

_GUESS = "SELECT _seq, company_size, (company_size + _seq) % 7 + 1 AS predicted FROM cln WHERE company_size IS NOT NULL"

ORACLE = {
    "column_fingerprint": sql(
        'SELECT source, "column", n_rows, ' + ", ".join(f"round({e}, 6) AS {n}" for n, e in _FEATURE_SQL.items())
        + " FROM sums", "fx", cells=_CELLS, measured=_MEASURED, sums=_SUMS),
    "fingerprint_state": sql(
        'SELECT source, "column", n_rows, ' + ", ".join(f"round({e}, 6) AS {n}" for n, e in _FEATURE_SQL.items())
        + " FROM sums", "fx", cells=_CELLS, measured=_MEASURED, sums=_SUMS),
    "sample_values": sql(
        """SELECT "column", position, value FROM (
        SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY min(_seq), value) AS position
        FROM seen WHERE value <> '' GROUP BY "column", value) WHERE position <= 5""", "fx",
        seen=" UNION ALL ".join(f"SELECT _seq, '{c}' AS \"column\", {c} AS value FROM fx" for c in COMPANY.names)),
    "stratified_split": sql(
        """SELECT company_size, count(*) AS rows, count(*) FILTER (t) AS test_rows,
        min(_seq) FILTER (t) AS first_test_seq, CAST(sum(_seq) FILTER (t) AS BIGINT) AS test_seq_sum FROM (
        SELECT *, row_number() OVER (PARTITION BY company_size ORDER BY md5('42|' || _seq::VARCHAR), _seq)
          <= least(greatest(1, round_even(0.25 * count(*) OVER (PARTITION BY company_size), 0)),
                   count(*) OVER (PARTITION BY company_size) - 1) AS t
        FROM cln WHERE company_size IS NOT NULL) GROUP BY company_size"""),
    "macro_f1": sql(
        """SELECT round(avg(CASE WHEN t + p = 0 THEN 0.0 ELSE 2.0 * tp / (t + p) END), 9) AS macro_f1, count(*) AS classes FROM (
        SELECT label, (SELECT count(*) FROM g WHERE company_size = label) AS t,
        (SELECT count(*) FROM g WHERE predicted = label) AS p,
        (SELECT count(*) FROM g WHERE predicted = label AND company_size = label) AS tp
        FROM (SELECT company_size AS label FROM g UNION SELECT predicted FROM g))""", g=_GUESS),
    "confusion_matrix": sql(
        "SELECT company_size, " + ", ".join(f'count(*) FILTER (predicted = {i}) AS "{i}"' for i in range(1, 8))
        + " FROM g GROUP BY company_size", g=_GUESS),
    "misclassified": sql("SELECT _seq AS seq, company_size, predicted FROM g WHERE company_size <> predicted", g=_GUESS),
    "contract_profile": sql(
        """SELECT source, "column", n_rows, null_count, value_count, distinct_count, all_int, ordinal_candidate,
        boolean_text, bool_parseable, round(iso_rate, 6) AS iso_rate, round(us_rate, 6) AS us_rate,
        round(min_number, 6) AS min_number, round(max_number, 6) AS max_number FROM profile""",
        "fx", cells=_CELLS, flags=_FLAGS, profile=_PROFILE),
    "observed_values": sql(
        """SELECT f."column", row_number() OVER (PARTITION BY f."column" ORDER BY v) - 1 AS position, v AS value
        FROM flags f JOIN profile p ON f.source = p.source AND f."column" = p."column"
        WHERE f.source = 'feed' AND v IS NOT NULL AND distinct_count BETWEEN 1 AND 20""",
        "fx", cells=_CELLS, flags=_FLAGS, profile=_PROFILE),
    "field_specs": sql(
        f"""SELECT "column", predicted_type,
        CASE WHEN kind = 'identifier' AND all_int THEN 'int' WHEN kind = 'date' AND iso_rate >= 0.95 THEN 'date'
             WHEN kind = 'boolean' AND bool_parseable THEN 'bool' WHEN kind = 'numeric_continuous' THEN 'float'
             ELSE 'str' END AS python_type,
        kind = 'identifier' AS required, (kind = 'url')::BIGINT AS constraints,
        ((kind IN ('categorical', 'numeric_continuous') AND value_count > 0) OR kind IN ('geographic', 'url')
          OR (kind = 'date' AND iso_rate >= 0.95))::BIGINT AS comments,
        {_FLAG_COUNT} AS risk_flags FROM specs""",
        "fx", cells=_CELLS, flags=_FLAGS, profile=_PROFILE, types=_TYPES, specs=_SPECS),
    "contract_summary": sql(
        f"""SELECT count(*) AS columns, count(*) FILTER (confidence < 0.6) AS low_confidence,
        count(*) FILTER ({_FLAG_COUNT} > 0) AS flagged FROM specs""",
        "fx", cells=_CELLS, flags=_FLAGS, profile=_PROFILE, types=_TYPES, specs=_SPECS),
    "inferred_contract_passrate": sql(
        f"""SELECT contract, total, passed, total - passed AS failed, round(passed / total, 6) AS pass_rate FROM (
        SELECT 'declared' AS contract, count(*) AS total,
          count(*) FILTER (e_id IS NULL AND e_size IS NULL AND e_url IS NULL) AS passed FROM chk
        UNION ALL SELECT 'inferred', count(*), count(*) FILTER (company_id IS NOT NULL
          AND coalesce({matches('url', tx.URL_SHAPE)}, true)
          AND (zip_code IS NULL OR {matches('zip_code', tx.FLOAT)})) FROM chk)""", "chk"),
}
