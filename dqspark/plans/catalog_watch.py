"""Queries over results: drift, review, reports, collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators import collide, contract, drift, report, review
from dqspark.operators.quarantine import RULE
from dqspark.plans import companies as co
from dqspark.plans.catalog_score import _first
from dqspark.plans.sqltext import quote, sql
from dqspark.sources.durable import pin
from dqspark.sources.sinks import new_reviews, raw_json

SPLIT_DATE = "1998-01-01"
FLAG_FROM = 90


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(baseline, batch): orders before a date, and from it on."""
    orders = co.table(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.lit(SPLIT_DATE).cast("timestamp_ntz")
    return orders.filter(~late), orders.filter(late)


def _feed_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(baseline, batch) of the raw feed: cut by a hash of the row number."""
    feed = co.feed(spark, sf, "_seq", "company_size", "state", "description")
    batch = F.substring(F.md5(F.col("_seq").cast("string")), 1, 1) < "5"
    return feed.filter(~batch), feed.filter(batch)


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return drift.value_counts(co.feed(spark, sf, "company_size"), "company_size")


def null_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return drift.null_buckets(co.feed(spark, sf, "state"), "state")


def length_hist(spark: SparkSession, sf: str) -> DataFrame:
    return drift.length_histogram(co.feed(spark, sf, "description"), "description")


def drift_profile(spark: SparkSession, sf: str) -> DataFrame:
    return drift.build_profile(co.feed(spark, sf, "company_size", "state", "description"))


def drift_draw(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline and batch drawn from the orders, by status."""
    orders = co.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sides = drift.draw_batches(orders, "o_orderkey")
    parts = [df.select(F.lit(name).alias("side"), "o_orderstatus") for name, df in zip(("baseline", "batch"), sides, strict=True)]
    return parts[0].unionAll(parts[1]).groupBy("side", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


def psi(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _orders(spark, sf)
    parts = [
        drift.psi(drift.value_counts(a, c), drift.value_counts(b, c)).select(F.lit(c).alias("column"), F.round("psi", 9).alias("psi"), "severity")
        for c in ("o_orderpriority", "o_orderstatus")
    ]
    return parts[0].unionByName(parts[1])


def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _orders(spark, sf)
    return drift.ks_of_values(a, b, "o_totalprice").select(
        F.round("statistic", 9).alias("statistic"), F.round("p_value", 6).alias("p_value"), "severity", "n1", "n2"
    )


def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _feed_sides(spark, sf)
    out = drift.check_drift(drift.build_profile(a), drift.build_profile(b))
    return out.withColumns({"value": F.round("value", 6), "p_value": F.round("p_value", 6)})


def drift_status(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_status(drift_report(spark, sf)).select("metric", "kind", "value", "severity")


def quarantine_table(spark: SparkSession, sf: str) -> DataFrame:
    """Contract failures and score flags of the feed as stored records, one write per day of ``_seq``."""
    annotated = co.annotated(spark, sf)
    failed = contract.invalid_rows(annotated).select("_seq", raw_json(F.col("raw")).alias("raw_data"), "reasons")
    score = (F.col("_seq") * 37 % 101) / 100.0
    flag = F.array(F.struct(
        F.lit(RULE).alias("rule"), F.lit("score").alias("message"), F.lit("warning").alias("severity"),
        F.lit("1").alias("model_version"), score.alias("score"),
        F.create_map(F.lit("name_len"), F.length("record.name").cast("double")).alias("features"),
    )).cast(contract.REASONS_TYPE)
    flagged = annotated.filter((F.size("reasons") == 0) & (F.col("_seq") * 37 % 101 >= FLAG_FROM)).select(
        "_seq", raw_json(F.col("record")).alias("raw_data"), flag.alias("reasons")
    )
    return failed.unionByName(flagged).select(
        F.col("_seq").alias("id"), "raw_data", "reasons", _stamp().alias("quarantined_at")
    )


def _stamp():
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("_seq") % 5).cast("int"))


def review_table(records: DataFrame) -> DataFrame:
    decision = F.when(F.col("id") % 6 == 0, "confirmed_bad").otherwise("false_positive")
    return records.filter(F.col("id") % 3 == 0).select(F.col("id").alias("record_id"), decision.alias("decision"))


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    records = pin(quarantine_table(spark, sf), "records")
    queue = review.review_queue(records, review_table(records), review.PAGE)
    return queue.select("record_id", F.round("score", 6).alias("score"), F.col("features")["name_len"].alias("name_len"),
                        F.get_json_object("raw_data", "$.company_id").alias("company_id"))


def review_progress(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_progress(review_table(quarantine_table(spark, sf)))


def review_submit(spark: SparkSession, sf: str) -> DataFrame:
    """Second decisions and unknown decisions change nothing."""
    records = pin(quarantine_table(spark, sf).select("id"), "ids")
    existing = review_table(records)
    word = F.when(F.col("id") % 7 == 0, "maybe").otherwise("confirmed_bad")
    submitted = records.select(
        F.col("id").alias("record_id"), word.alias("decision"), F.lit("2024-02-01").cast("timestamp").alias("reviewed_at")
    )
    return new_reviews(existing, submitted).select("record_id", "decision")


def reviewed_labels(spark: SparkSession, sf: str) -> DataFrame:
    records = pin(quarantine_table(spark, sf), "records")
    return review.reviewed_labels(records, review_table(records)).select(
        "record_id", "company_id", "is_synthetic", "label", "corruption_type", F.col("features")["name_len"].alias("name_len")
    )


def retrain_set(spark: SparkSession, sf: str) -> DataFrame:
    records = pin(quarantine_table(spark, sf), "records")
    human = review.reviewed_labels(records, review_table(records)).select(F.col("record_id").alias("key"), "corruption_type")
    kind = F.when(F.col("quality") == 0, "clean").when(F.col("doc_id") % 3 == 0, "encoding").otherwise("truncation")
    synthetic = co.table(spark, sf, "labels").select(F.col("doc_id").alias("key"), kind.alias("corruption_type"))
    return review.retrain_sets(synthetic, human, "key").groupBy("origin", "corruption_type", "is_test").agg(
        F.count(F.lit(1)).alias("rows")
    )


def _clean_table(spark: SparkSession, sf: str) -> DataFrame:
    return _first(spark, sf).withColumn("loaded_at", _stamp())


def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    out = report.latest_run(_clean_table(spark, sf), quarantine_table(spark, sf))
    return out.withColumns({c: F.col(c).cast("string") for c in ("clean_written_at", "quarantine_written_at")})


def reasons_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return report.latest_reasons(pin(quarantine_table(spark, sf), "records"))


def quarantine_rate(spark: SparkSession, sf: str) -> DataFrame:
    run = report.latest_run(_clean_table(spark, sf), quarantine_table(spark, sf))
    rate = report.quarantine_rate(F.col("clean_count"), F.col("quarantine_count"))
    return run.select("clean_count", "quarantine_count", F.round(rate, 6).alias("rate"))


def latest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    runs = co.table(spark, sf, "events").select(
        F.col("event_type").alias("experiment"), F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"), F.col("value").alias("metric")
    )
    return report.latest_metrics(runs, "experiment", "started_at", "run_id").select("experiment", "run_id", "metric")


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    versions = co.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("model"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderpriority").alias("winner")
    )
    return report.latest_version(versions, "model", "version")


def name_collisions(spark: SparkSession, sf: str) -> DataFrame:
    parts = co.table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.when(F.col("p_size") > 25, ", Inc.").otherwise("  Holdings LLC")).alias("name")
    )
    return collide.name_collisions(parts, "name", "p_partkey")


def name_variance(spark: SparkSession, sf: str) -> DataFrame:
    return collide.name_variance(co.feed(spark, sf, "company_id", "name"), "company_id", "name")


def repeat_groups(spark: SparkSession, sf: str) -> DataFrame:
    return collide.repeat_groups(co.table(spark, sf, "documents"), "source", "text").withColumn("share", F.round("share", 6))


def repeat_by_location(spark: SparkSession, sf: str) -> DataFrame:
    return collide.repeat_by_location(co.table(spark, sf, "documents"), "lang", "text", "source").withColumn("share", F.round("share", 6))


def id_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return collide.id_overlap(co.table(spark, sf, "supplier"), "s_suppkey", co.table(spark, sf, "orders"), "o_custkey")


def repeat_same_day(spark: SparkSession, sf: str) -> DataFrame:
    return collide.repeat_same_day(co.table(spark, sf, "events"), "user_id", "event_type", "ts").withColumn("share", F.round("share", 6))


QUERIES = {
    "value_counts": value_counts,
    "null_buckets": null_buckets,
    "length_hist": length_hist,
    "drift_profile": drift_profile,
    "psi": psi,
    "drift_draw": drift_draw,
    "ks_statistic": ks_statistic,
    "drift_report": drift_report,
    "drift_status": drift_status,
    "review_queue": review_queue,
    "review_progress": review_progress,
    "review_submit": review_submit,
    "reviewed_labels": reviewed_labels,
    "retrain_set": retrain_set,
    "latest_run": latest_run,
    "reasons_by_rule": reasons_by_rule,
    "quarantine_rate": quarantine_rate,
    "latest_metrics": latest_metrics,
    "latest_version": latest_version,
    "name_collisions": name_collisions,
    "name_variance": name_variance,
    "repeat_groups": repeat_groups,
    "repeat_by_location": repeat_by_location,
    "id_overlap": id_overlap,
    "repeat_same_day": repeat_same_day,
}

_BANDS = "CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END"
_KS_BANDS = "CASE WHEN p < 0.01 THEN 'significant' WHEN p < 0.05 THEN 'moderate' ELSE 'none' END"
_P = """CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0::DOUBLE * k * k * lam * lam))))) END"""
_PROFILE = """SELECT {g}, 'category' AS metric, coalesce(company_size, 'null') AS bucket FROM {t}
UNION ALL SELECT {g}, 'nulls', CASE WHEN state IS NULL THEN 'null' ELSE 'non_null' END FROM {t}
UNION ALL SELECT {g}, 'length', length(description)::VARCHAR FROM {t} WHERE description IS NOT NULL"""


def _psi_sql(pairs: str, group: str) -> str:
    """``pairs`` has group, bucket, a, b."""
    return f"""SELECT {group}, sum((pb - pa) * ln(pb / pa)) AS psi FROM (
      SELECT {group}, greatest(a / sum(a) OVER (PARTITION BY {group}), 1e-4::DOUBLE) AS pa,
        greatest(b / sum(b) OVER (PARTITION BY {group}), 1e-4::DOUBLE) AS pb FROM {pairs}) GROUP BY {group}"""


def _ks_sql(steps: str) -> str:
    """``steps`` has v, a, b; the statistic, the sizes and the corrected argument of the limiting series."""
    return f"""SELECT d, n1, n2, r + 1 / (6 * sqrt(e)) + (r - 1) / (4 * e) AS lam FROM (
      SELECT *, d * sqrt(e) AS r FROM (SELECT *, round(n1::DOUBLE * n2 / (n1 + n2)) AS e FROM (
      SELECT max(abs(ca / ta - cb / tb)) AS d, CAST(max(ta) AS BIGINT) AS n1, CAST(max(tb) AS BIGINT) AS n2 FROM (
        SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM {steps}
        WINDOW w AS (ORDER BY v)))))"""


def _ks_p(k0: str) -> str:
    """The sizes and p: paths inside the band counted place by place while no side has over 10,000 values."""
    frame = f"""SELECT *, least(n1, n2) AS m, greatest(n1, n2) AS n, greatest(n1, n2) // gcd(n1, n2) AS down,
      least(n1, n2) // gcd(n1, n2) AS across, CAST(round(d * n1 * n2 / gcd(n1, n2)) AS BIGINT) AS reach, greatest(n1, n2) <= 10000 AS few FROM {k0}"""
    return f"""SELECT d, n1, n2, CASE WHEN NOT few THEN {_P} WHEN reach <= 0 THEN 1.0 ELSE coalesce((
      WITH RECURSIVE f AS ({frame}), walk AS (
        SELECT CAST(0 AS BIGINT) AS i, j, 1.0::DOUBLE AS c, 0.0::DOUBLE AS s FROM f, range(0, n + 1) AS t(j) WHERE few AND j * across < reach
        UNION ALL
        SELECT i, j, c / last, s + ln(last) FROM (
          SELECT i, j, s, sum(c) OVER (ORDER BY j) AS c, sum(c) OVER () AS last FROM (
            SELECT b.i, t.j, b.s, coalesce(w.c, 0.0) AS c
            FROM (SELECT max(walk.i) + 1 AS i, max(walk.s) AS s FROM walk HAVING count(*) > 0) b, f, range(0, f.n + 1) AS t(j)
            LEFT JOIN walk w ON w.j = t.j WHERE b.i <= f.m AND abs(b.i * f.down - t.j * f.across) < f.reach)) WHERE last > 0)
      SELECT greatest(0.0, 1 - exp(s + ln(c) - (lgamma(m + n + 1) - lgamma(m + 1) - lgamma(n + 1)))) FROM walk, f WHERE i = m AND j = n AND c > 0), 1.0)
      END AS p FROM ({frame})"""


_SIDES = "SELECT *, substr(md5(_seq::VARCHAR), 1, 1) < '5' AS batch FROM fx"
_REPORT = {
    "sides": _SIDES,
    "cells": _PROFILE.format(g="batch", t="sides"),
    "cnt": "SELECT metric, bucket, count(*) FILTER (NOT batch) AS a, count(*) FILTER (batch) AS b FROM cells GROUP BY metric, bucket",
    "cat": "SELECT * FROM cnt WHERE metric <> 'length'",
    "ps": _psi_sql("cat", "metric"),
    "len": "SELECT bucket::BIGINT AS v, a, b FROM cnt WHERE metric = 'length'",
    "k0": _ks_sql("len"),
    "k1": _ks_p("k0"),
    "rep": f"""SELECT CASE WHEN metric = 'category' THEN 'company_size' ELSE 'state_null_rate' END AS metric, 'psi' AS kind,
      round(psi, 6) AS value, CAST(NULL AS DOUBLE) AS p_value, {_BANDS} AS severity FROM ps
      UNION ALL SELECT 'description_len', 'ks', round(d, 6), round(p, 6), {_KS_BANDS} FROM k1""",
}
_LATE = f"o_orderdate >= TIMESTAMP '{SPLIT_DATE}'"
_ORDER_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS bucket, count(*) FILTER (NOT {_LATE}) AS a, count(*) FILTER ({_LATE}) AS b FROM orders GROUP BY {c}"
    for c in ("o_orderpriority", "o_orderstatus")
)
_FIRST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY _seq) AS rn FROM cln) WHERE rn = 1"
_RUN = {
    "first": _FIRST,
    "cl": "SELECT DATE '2024-01-01' + (_seq % 5)::INT AS day FROM first",
    "qu": "SELECT DISTINCT id, DATE '2024-01-01' + (id % 5)::INT AS day FROM recs",
}
_FLAGS = "SELECT * FROM recs WHERE rule = 'quarantine_classifier'"
_SPLITS = """
SELECT origin, corruption_type, row_number() OVER (PARTITION BY origin, corruption_type ORDER BY md5('42|' || key::VARCHAR), key)
  <= CASE WHEN count(*) OVER w < 2 THEN 0 ELSE least(greatest(1, round_even(0.2 * count(*) OVER w, 0)), count(*) OVER w - 1) END AS is_test
FROM keys WINDOW w AS (PARTITION BY origin, corruption_type)"""
_KEYS = """
SELECT 'synthetic' AS origin, doc_id AS key, CASE WHEN quality = 0 THEN 'clean' WHEN doc_id % 3 = 0 THEN 'encoding' ELSE 'truncation' END AS corruption_type FROM labels
UNION ALL SELECT 'human', id, CASE WHEN decision = 'confirmed_bad' THEN 'human_confirmed_bad' ELSE 'human_false_positive' END
FROM flags JOIN revs ON id = record_id"""
_PLAIN = "lower(p_name || CASE WHEN p_size > 25 THEN ', Inc.' ELSE '  Holdings LLC' END)"
_BARE = f"""regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')),
  {quote(collide.NOT_WORD)}, '', 'g'), '\\s+', ' ', 'g')), {quote(collide.NAME_TAIL)}, '')"""

ORACLE = {
    "value_counts": sql("SELECT coalesce(company_size, 'null') AS bucket, count(*) AS count FROM fx GROUP BY 1", "fx"),
    "null_buckets": sql(
        "SELECT 'null' AS bucket, count(*) - count(state) AS count FROM fx UNION ALL SELECT 'non_null', count(state) FROM fx", "fx"),
    "length_hist": sql("SELECT length(description) AS length, count(*) AS count FROM fx WHERE description IS NOT NULL GROUP BY 1", "fx"),
    "drift_profile": sql("SELECT metric, bucket, count(*) AS count FROM c GROUP BY ALL", "fx", c=_PROFILE.format(g="1 AS g", t="fx").replace("1 AS g, ", "")),
    "drift_draw": """
WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 12000),
b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
  ORDER BY md5('43|' || o_orderkey::VARCHAR), o_orderkey LIMIT 6000)
SELECT 'baseline' AS side, o_orderstatus, count(*) AS rows FROM a GROUP BY ALL
UNION ALL SELECT 'batch', o_orderstatus, count(*) FROM b GROUP BY ALL""",
    "psi": sql(f'SELECT col AS "column", round(psi, 9) AS psi, {_BANDS} AS severity FROM ps', None, cnt=_ORDER_CELLS, ps=_psi_sql("cnt", "col")),
    "ks_statistic": sql(
        f"SELECT round(d, 9) AS statistic, round(p, 6) AS p_value, {_KS_BANDS} AS severity, n1, n2 FROM k1", None,
        steps=f"SELECT o_totalprice AS v, count(*) FILTER (NOT {_LATE}) AS a, count(*) FILTER ({_LATE}) AS b FROM orders GROUP BY 1",
        k0=_ks_sql("steps"), k1=_ks_p("k0")),
    "drift_report": sql(
        "SELECT *, (SELECT bool_or(severity <> 'none') FROM rep) AS any_flagged FROM rep", "fx", **_REPORT),
    "drift_status": sql("SELECT metric, kind, value, severity FROM rep ORDER BY value DESC, metric", "fx", **_REPORT),
    "review_queue": sql(
        """SELECT id AS record_id, round(score, 6) AS score, length(name)::DOUBLE AS name_len, company_id FROM (
        SELECT id FROM (SELECT DISTINCT id FROM recs WHERE id NOT IN (SELECT record_id FROM revs)) ORDER BY id % 5 DESC, id LIMIT 200)
        JOIN flags USING (id)""", "revs", flags=_FLAGS),
    "review_progress": sql(
        """SELECT count(*) FILTER (decision = 'confirmed_bad') AS confirmed_bad, count(*) FILTER (decision = 'false_positive') AS false_positive,
        count(*) AS total, count(*) >= 20 AS retrain_unlocked FROM revs""", "revs"),
    "review_submit": sql(
        "SELECT DISTINCT id AS record_id, 'confirmed_bad' AS decision FROM recs WHERE id % 7 <> 0 AND id NOT IN (SELECT record_id FROM revs)", "revs"),
    "reviewed_labels": sql(
        """SELECT record_id, company_id, false AS is_synthetic, (decision = 'confirmed_bad')::INT AS label,
        CASE WHEN decision = 'confirmed_bad' THEN 'human_confirmed_bad' ELSE 'human_false_positive' END AS corruption_type,
        length(name)::DOUBLE AS name_len FROM flags JOIN revs ON id = record_id""", "revs", flags=_FLAGS),
    "retrain_set": sql(
        "SELECT origin, corruption_type, is_test, count(*) AS rows FROM sp GROUP BY ALL", "revs", flags=_FLAGS, keys=_KEYS, sp=_SPLITS),
    "latest_run": sql(
        """SELECT (SELECT max(day) FROM cl)::VARCHAR AS clean_written_at, (SELECT count(*) FROM cl WHERE day = (SELECT max(day) FROM cl)) AS clean_count,
        (SELECT max(day) FROM qu)::VARCHAR AS quarantine_written_at, (SELECT count(*) FROM qu WHERE day = (SELECT max(day) FROM qu)) AS quarantine_count""",
        "recs", **_RUN),
    "reasons_by_rule": sql(
        "SELECT rule, count(*) AS count FROM recs WHERE id % 5 = (SELECT max(id % 5) FROM recs) GROUP BY rule", "recs"),
    "quarantine_rate": sql(
        """SELECT c AS clean_count, q AS quarantine_count, round(q / (c + q), 6) AS rate FROM (
        SELECT (SELECT count(*) FROM cl WHERE day = (SELECT max(day) FROM cl)) AS c, (SELECT count(*) FROM qu WHERE day = (SELECT max(day) FROM qu)) AS q)""",
        "recs", **_RUN),
    "latest_metrics": """SELECT event_type AS experiment, arg_max(event_id, (ts, event_id)) AS run_id, arg_max(value, (ts, event_id)) AS metric
        FROM events GROUP BY event_type""",
    "latest_version": """SELECT o_custkey AS model, max(o_orderkey)::VARCHAR AS version, arg_max(o_orderpriority, o_orderkey) AS winner
        FROM orders GROUP BY o_custkey""",
    "name_collisions": f"""SELECT bare_name, count(DISTINCT p_partkey) AS keys, count(*) AS rows FROM (SELECT p_partkey, {_BARE} AS bare_name FROM part)
        GROUP BY bare_name HAVING count(DISTINCT p_partkey) > 1""",
    "name_variance": sql(
        """SELECT count(*) AS keys, count(*) FILTER (s > 1) AS varying_keys, max(s) AS max_spellings
        FROM (SELECT count(DISTINCT name) AS s FROM fx WHERE company_id IS NOT NULL GROUP BY company_id)""", "fx"),
    "repeat_groups": """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS groups, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS group_rows,
        round(sum(n) FILTER (n > 1) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM documents GROUP BY source, text)""",
    "repeat_by_location": """SELECT bucket, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM (
        SELECT CASE WHEN count(DISTINCT source) > 1 THEN 'several locations' ELSE 'one location' END AS bucket, count(*) AS n
        FROM documents GROUP BY lang, text HAVING count(*) > 1) GROUP BY bucket""",
    "id_overlap": """SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (b IS NULL) AS left_only,
        count(*) FILTER (a IS NULL) AS right_only FROM (SELECT DISTINCT s_suppkey AS a FROM supplier) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders) ON a = b""",
    "repeat_same_day": """SELECT count(*) FILTER (n > 1) AS groups, count(*) FILTER (n > 1 AND hi <= lo + INTERVAL 1 DAY) AS same_day_groups,
        date_diff('day', min(lo), max(hi)) AS span_days, round(count(*) FILTER (n > 1 AND hi <= lo + INTERVAL 1 DAY) / count(*) FILTER (n > 1), 6) AS share
        FROM (SELECT count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id, event_type)""",
}
