"""Queries over row quality: features, zip reference, labeled rows, metrics, the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions import text as tx
from dqspark.operators import augment, iforest, metrics, quarantine, ranking, rowfeat, zip3
from dqspark.operators.rowfeat import ROW_FEATURES, SHAPE_FEATURES
from dqspark.plans import companies as co
from dqspark.plans.sqltext import count_of, draw, matches, quote, sql
from dqspark.sources.durable import pin
from dqspark.sources.sinks import first_per_key

SHARE = 800 / 24473
TREES, ROUNDS = 100, 20


def _first(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned records, one per key, written once because every query here reads them repeatedly."""
    return pin(first_per_key(_rows(spark, sf), "company_id"), "first")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return pin(co.cleaned(spark, sf), "rows")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """What the zip operators read."""
    return pin(co.cleaned(spark, sf).select("_seq", "company_id", "state", "country", "zip_code"), "places")


def zip3_rows(spark: SparkSession, sf: str) -> DataFrame:
    return zip3.us_rows(co.cleaned(spark, sf)).select(F.col("_seq").alias("seq"), "zip3", "state_clean")


def zip3_reference(spark: SparkSession, sf: str) -> DataFrame:
    return zip3.zip3_reference(co.cleaned(spark, sf))


def zip3_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = _places(spark, sf)
    return zip3.zip3_pool(rows, zip3.zip3_reference(rows))


def zip3_eligible(spark: SparkSession, sf: str) -> DataFrame:
    rows = _places(spark, sf)
    return zip3.eligible_rows(rows, zip3.zip3_reference(rows)).select(F.col("_seq").alias("seq"), "zip3", "state_clean")


def zip3_consistency(spark: SparkSession, sf: str) -> DataFrame:
    rows = _places(spark, sf)
    return zip3.consistency(rows, zip3.zip3_reference(rows)).withColumn("rate", F.round("rate", 6))


def row_quality_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return rowfeat.row_features(rows, zip3.zip3_reference(rows)).select(
        F.col("_seq").alias("seq"), *[F.round(f, 6).alias(f) for f in ROW_FEATURES]
    )


def sample_exact_n(spark: SparkSession, sf: str) -> DataFrame:
    orders = co.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.sample_exact_n(orders, "o_orderkey", 12_000, 42)


def corrupt_encoding(spark: SparkSession, sf: str) -> DataFrame:
    rows = augment.damage_encoding(_first(spark, sf), "company_id")
    return rows.select("company_id", "name", "description")


def corrupt_truncation(spark: SparkSession, sf: str) -> DataFrame:
    rows = augment.damage_truncation(_first(spark, sf), "company_id")
    return rows.select("company_id", "name", "description")


def corrupt_nulls(spark: SparkSession, sf: str) -> DataFrame:
    rows = augment.damage_nulls(_first(spark, sf), "company_id")
    return rows.select("company_id", "name", "url", *rowfeat.OPTIONAL)


def corrupt_zip(spark: SparkSession, sf: str) -> DataFrame:
    rows = first_per_key(_places(spark, sf), "company_id")
    reference = zip3.zip3_reference(rows)
    eligible = zip3.eligible_rows(rows, reference)
    swapped = augment.damage_zip(eligible, "company_id", reference, zip3.zip3_pool(rows, reference))
    return swapped.select("company_id", "state", "zip_code")


def labeled_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return augment.labeled_dataset(_first(spark, sf), "company_id", SHARE, written=True).select(
        "company_id", "is_synthetic", "label", "corruption_type"
    )


def labeled_features(spark: SparkSession, sf: str) -> DataFrame:
    """Mean features per corruption type, computed after the damage."""
    rows = augment.labeled_dataset(_first(spark, sf), "company_id", SHARE, written=True)
    return rows.groupBy("corruption_type").agg(
        F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(f), 6).alias(f) for f in ROW_FEATURES]
    )


def row_label(spark: SparkSession, sf: str) -> DataFrame:
    labels = co.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, F.col("quality")).alias("label"), (F.col("quality") == 1).alias("is_synthetic")
    )
    return labels.select("doc_id", augment.row_label(labels).alias("label"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("quality") == 0, "clean").when(F.col("doc_id") % 3 == 0, "encoding").otherwise("truncation")
    return co.table(spark, sf, "labels").select(
        ((F.col("doc_id") * 37 % 101) / 100.0).alias("score"), F.col("quality").alias("label"), kind.alias("kind")
    )


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, sf), "score", "label").select(
        F.round("average_precision", 9).alias("average_precision")
    )


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rates = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    return metrics.binary_metrics(_scored(spark, sf), "score", "label").select("n", "tp", "fp", "fn", *rates)


def clean_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.clean_fpr(_scored(spark, sf), "score", "kind").withColumn("clean_fpr", F.round("clean_fpr", 9))


def per_type_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rates = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    return metrics.per_type_metrics(_scored(spark, sf), "score", "label", "kind").select("kind", "n", *rates)


def anomaly_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = _first(spark, sf)
    featured = pin(rowfeat.row_features(rows, zip3.zip3_reference(rows)).select("company_id", *SHAPE_FEATURES), "shape")
    forest = iforest.fit(featured, SHAPE_FEATURES, "company_id", TREES)
    sample = min(iforest.SAMPLE, featured.limit(iforest.SAMPLE).count())
    return featured.select("company_id", iforest.anomaly_score(forest, SHAPE_FEATURES, sample).alias("score"))


def _trained(first: DataFrame):
    labeled = augment.labeled_dataset(first, "company_id", SHARE, written=True)
    return quarantine.train(labeled, "company_id", ROUNDS, TREES)


def quarantine_model(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out recall, precision and F1 per damage type, and the overall numbers."""
    _, result = _trained(_first(spark, sf))
    rows = [(k, float(m["precision"]), float(m["recall"]), float(m["f1"])) for k, m in result["per_type"].items()]
    rows.append(("all", float(result["precision"]), float(result["recall"]), float(result["f1"])))
    return spark.createDataFrame(rows, "kind string, precision double, recall double, f1 double").withColumn(
        "pr_auc", F.lit(float(result["pr_auc"]))
    )


def score_and_route(spark: SparkSession, sf: str) -> DataFrame:
    first = _first(spark, sf)
    model, _ = _trained(first)
    kept, flagged = quarantine.score_and_route(first, model)
    return kept.agg(F.lit("kept").alias("side"), F.count(F.lit(1)).alias("rows")).unionByName(
        flagged.agg(F.lit("flagged").alias("side"), F.count(F.lit(1)).alias("rows"))
    )


def route_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every row comes out of the routing once: rows and keys of both sides together."""
    first = _first(spark, sf)
    labeled = augment.labeled_dataset(first, "company_id", SHARE, written=True)
    model, _ = quarantine.train(labeled, "company_id", 3, 20)
    kept, flagged = quarantine.score_and_route(first, model)
    both = kept.select("company_id").unionAll(flagged.select("raw.company_id"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("company_id").alias("keys"))


QUERIES = {
    "zip3_rows": zip3_rows,
    "zip3_reference": zip3_reference,
    "zip3_pool": zip3_pool,
    "zip3_eligible": zip3_eligible,
    "zip3_consistency": zip3_consistency,
    "row_quality_features": row_quality_features,
    "sample_exact_n": sample_exact_n,
    "corrupt_encoding": corrupt_encoding,
    "corrupt_truncation": corrupt_truncation,
    "corrupt_null_storm": corrupt_nulls,
    "corrupt_zip": corrupt_zip,
    "labeled_dataset": labeled_dataset,
    "labeled_features": labeled_features,
    "row_label": row_label,
    "average_precision": average_precision,
    "binary_metrics": binary_metrics,
    "clean_fpr": clean_fpr,
    "per_type_metrics": per_type_metrics,
    "anomaly_score": anomaly_score,
    "quarantine_model": quarantine_model,
    "score_and_route": score_and_route,
    "route_rows": route_rows,
}

_D = "coalesce(t.description, '')"
_N = "coalesce(t.name, '')"
_TAIL = f"right({_D}, 8)"
_CLASSES = [r"\p{Ll}", r"\p{Lu}", tx.digit_class(), rf"[^\p{{Ll}}\p{{Lu}}{tx.digit_class()[1:-1]}{tx.SPACE}]"]


def _rate(count: str, text: str) -> str:
    return f"round(CASE WHEN length({text}) = 0 THEN 0.0 ELSE ({count}) / length({text}) END, 6)"


_FEATURES = {
    "null_count": " + ".join(f"(t.{c} IS NULL)::INT" for c in rowfeat.OPTIONAL),
    **{f"{c}_len": f"length(coalesce(t.{c}, ''))" for c in ("name", "description", "address", "city", "url")},
    "description_frac_alpha": _rate(count_of(_D, r"\p{L}"), _D),
    "description_frac_digit": _rate(count_of(_D, tx.digit_class()), _D),
    "description_frac_punct": _rate(count_of(_D, f"[{tx.ASCII_PUNCT}]"), _D),
    "name_mojibake_rate": _rate(f"len(regexp_extract_all({_N}, {quote(tx.mojibake())}))", _N),
    "description_mojibake_rate": _rate(f"len(regexp_extract_all({_D}, {quote(tx.mojibake())}))", _D),
    "suspicious_char_rate": _rate(count_of(f"({_N} || {_D})", r"[^\x{20}-\x{7e}\t\n\r\x{0b}\x{0c}]"), f"({_N} || {_D})"),
    "ends_without_terminal_punct": f"({_D} <> '' AND NOT {matches(_D, rf'[.!?{chr(34)})' + chr(39) + rf'][{tx.SPACE}]*' + chr(92) + 'z')})::INT",
    "trailing_char_class_diversity": " + ".join(f"{matches(_TAIL, c)}::INT" for c in _CLASSES),
    "zip_state_mismatch": "CASE WHEN u._seq IS NULL OR r.state IS NULL THEN -1 WHEN r.state = u.state_clean THEN 0 ELSE 1 END",
    "contract_violation_count": """((t.company_id IS NULL)::INT + coalesce((t.company_size NOT BETWEEN 1 AND 7)::INT, 0)
      + coalesce((NOT regexp_matches(t.url, '^[hH][tT][tT][pP][sS]?:/*[^/ ]'))::INT, 1))""",
}
_FIRST = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY _seq) AS rn FROM cln) WHERE rn = 1"""
_FIRST_REF = """
SELECT zip3, arg_min(state_clean, (-n, state_clean)) AS state, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT zip3, state_clean, count(*) AS n FROM fus GROUP BY ALL) GROUP BY zip3 HAVING sum(n) >= 2"""
_FUS = "SELECT f.*, upper(trim(f.state)) AS state_clean, substr(f.zip_code, 1, 3) AS zip3 FROM first f WHERE f._seq IN (SELECT _seq FROM us)"
_RUNS = """
SELECT zip3, zip_code, n, CAST(sum(n) OVER (PARTITION BY zip3 ORDER BY zip_code) - n AS BIGINT) AS first_index
FROM (SELECT zip3, zip_code, count(*) AS n FROM {us} WHERE zip3 IN (SELECT zip3 FROM {ref}) GROUP BY ALL)"""

_TARGET = "CASE WHEN coalesce(description, '') <> '' THEN description ELSE coalesce(name, '') END"
_CUT = f"greatest(1, CAST(floor(length(txt) * (0.15::DOUBLE + 0.35::DOUBLE * ({draw('42cut', 'company_id')} / 4294967296.0::DOUBLE))) AS BIGINT))"
_GARBLE = " || ".join(
    f"CASE WHEN {i} <= {draw('42len', 'company_id')} % 6 + 3 THEN substr({quote(augment.GARBLE)}, CAST({draw(f'42g{i}', 'company_id')} % {len(augment.GARBLE)} + 1 AS BIGINT), 1) ELSE '' END"
    for i in range(1, 9)
)
_HASHES = "[" + ", ".join(f"md5('42{f}|' || company_id::VARCHAR)" for f in rowfeat.OPTIONAL) + "]"
_SWAP = "CASE c " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in augment.MISREAD.items()) + " ELSE c END"
_HITS = ", ".join(quote(k) for k in augment.MISREAD)
_ENCODE = [
    ("e1", f"SELECT *, {_TARGET} AS txt, coalesce(description, '') <> '' AS use_d FROM first"),
    ("e2", f"SELECT *, string_split(txt, '') AS chars, list_filter(list_transform(string_split(txt, ''), lambda c, i: CASE WHEN c IN ({_HITS}) THEN i END), lambda i: i IS NOT NULL) AS places FROM e1"),
    ("e3", f"""SELECT *, len(places) AS m, least(len(places), {draw('42hits', 'company_id')} % 3 + 1) AS hits,
      {draw('42a', 'company_id')} % greatest(len(places), 1) AS a, {draw('42b', 'company_id')} % greatest(len(places) - 1, 1) AS b0,
      {draw('42c', 'company_id')} % greatest(len(places) - 2, 1) AS c0 FROM e2"""),
    ("e4", "SELECT *, b0 + (b0 >= a)::INT AS b FROM e3"),
    ("e5", "SELECT *, c0 + (c0 >= least(a, b))::INT AS c1 FROM e4"),
    ("e6", "SELECT *, c1 + (c1 >= greatest(a, b))::INT AS c FROM e5"),
    ("e7", "SELECT *, list_transform(list_slice([a, b, c], 1, hits), lambda p: places[p + 1]) AS chosen FROM e6"),
    ("e8", f"""SELECT *, CASE WHEN m = 0 THEN substr(txt, 1, {draw('42at', 'company_id')} % (length(txt) + 1)) || {quote(augment.FRAGMENT)}
        || substr(txt, {draw('42at', 'company_id')} % (length(txt) + 1) + 1)
      ELSE array_to_string(list_transform(chars, lambda c, i: CASE WHEN list_contains(chosen, i) THEN {_SWAP} ELSE c END), '') END AS bad FROM e7"""),
]
_ASSIGN = [
    ("q", f"SELECT CAST(floor(count(*) * {SHARE!r}::DOUBLE) AS BIGINT) AS n FROM first"),
    ("elig", "SELECT company_id, row_number() OVER (ORDER BY md5('42zip|' || company_id::VARCHAR), company_id) AS r FROM fus WHERE zip3 IN (SELECT zip3 FROM fref)"),
    ("zips", "SELECT company_id FROM elig, q WHERE r <= n"),
    ("rest", "SELECT company_id, row_number() OVER (ORDER BY md5('42rest|' || company_id::VARCHAR), company_id) AS r FROM first WHERE company_id NOT IN (SELECT company_id FROM zips)"),
    ("kinds", """SELECT company_id, 'zip_state_mismatch' AS k FROM zips UNION ALL
      SELECT company_id, CASE WHEN r <= n THEN 'encoding' WHEN r <= 2 * n THEN 'truncation' WHEN r <= 3 * n THEN 'null_storm' ELSE 'clean' END FROM rest, q"""),
]
_FIRSTS = {"first": _FIRST, "fus": _FUS, "fref": _FIRST_REF}
_LABELS = """SELECT (doc_id * 37 % 101) / 100.0 AS score, quality AS label,
CASE WHEN quality = 0 THEN 'clean' WHEN doc_id % 3 = 0 THEN 'encoding' ELSE 'truncation' END AS kind FROM labels"""


def _prf(tp: str, fp: str, fn: str) -> str:
    def div(a: str, b: str) -> str:
        return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / ({b}) END, 9)"

    return f"{div(tp, f'({tp} + {fp})')} AS precision, {div(tp, f'({tp} + {fn})')} AS recall, {div(f'2.0 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1"


_ZIP = [
    ("idx", "SELECT zip3, state, row_number() OVER (ORDER BY state, zip3) - 1 AS i FROM fref"),
    ("run", "SELECT state, min(i) AS lo, count(*) AS own FROM idx GROUP BY state"),
    ("pool", _RUNS.format(us="fus", ref="fref")),
    ("copies", "SELECT zip3, sum(n) AS copies FROM pool GROUP BY zip3"),
    ("pick", f"""SELECT f.company_id, f.state, f.zip_code, coalesce(own, 0) AS own, coalesce(lo, 0) AS lo,
      {draw('42zip3', 'f.company_id')} % greatest((SELECT count(*) FROM idx) - coalesce(own, 0), 1) AS j
      FROM fus f LEFT JOIN run ON f.state_clean = run.state WHERE f.zip3 IN (SELECT zip3 FROM fref)"""),
    ("aim", f"""SELECT p.*, idx.zip3, {draw('42zip', 'p.company_id')} % copies AS copy FROM pick p
      JOIN idx ON idx.i = CASE WHEN j >= lo THEN j + own ELSE j END JOIN copies ON copies.zip3 = idx.zip3"""),
]

ORACLE = {
    "zip3_rows": sql("SELECT _seq AS seq, zip3, state_clean FROM us", "us"),
    "zip3_reference": sql("SELECT zip3, state, n FROM ref", "ref"),
    "zip3_pool": sql(_RUNS.format(us="us", ref="ref"), "ref"),
    "zip3_eligible": sql("SELECT _seq AS seq, zip3, state_clean FROM us WHERE zip3 IN (SELECT zip3 FROM ref)", "ref"),
    "zip3_consistency": sql(
        """SELECT count(*) AS rows, count(*) FILTER (u.state_clean = r.state) AS consistent,
        round(count(*) FILTER (u.state_clean = r.state) / count(*), 6) AS rate FROM us u JOIN ref r ON u.zip3 = r.zip3""", "ref"),
    "row_quality_features": sql(
        "SELECT t._seq AS seq, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FEATURES.items())
        + " FROM cln t LEFT JOIN us u ON t._seq = u._seq LEFT JOIN ref r ON u.zip3 = r.zip3", "ref"),
    "route_rows": sql("SELECT count(DISTINCT company_id) AS rows, count(DISTINCT company_id) AS keys FROM cln"),
    "sample_exact_n": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 12000",
    "corrupt_encoding": sql(
        """SELECT company_id, CASE WHEN use_d THEN name ELSE bad END AS name, CASE WHEN use_d THEN bad ELSE description END AS description FROM e8""",
        "us", first=_FIRST, **dict(_ENCODE)),
    "corrupt_truncation": sql(
        f"""SELECT company_id, CASE WHEN use_d THEN name ELSE bad END AS name, CASE WHEN use_d THEN bad ELSE description END AS description
        FROM (SELECT *, substr(txt, 1, {_CUT}) || {_GARBLE} AS bad FROM e1)""", "cln", first=_FIRST, e1=_ENCODE[0][1]),
    "corrupt_null_storm": sql(
        "SELECT company_id, name, url, " + ", ".join(
            f"CASE WHEN list_position(list_sort(h), md5('42{f}|' || company_id::VARCHAR)) > k THEN {f} END AS {f}" for f in rowfeat.OPTIONAL)
        + f" FROM (SELECT *, {_HASHES} AS h, {draw('42nulls', 'company_id')} % 3 + 5 AS k FROM first)", "cln", first=_FIRST),
    "corrupt_zip": sql(
        """SELECT a.company_id, a.state, p.zip_code FROM aim a JOIN pool p ON a.zip3 = p.zip3 AND a.copy >= p.first_index
        AND a.copy < p.first_index + p.n""", "us", **_FIRSTS, **dict(_ZIP)),
    "labeled_dataset": sql(
        "SELECT company_id, k <> 'clean' AS is_synthetic, (k <> 'clean')::INT AS label, k AS corruption_type FROM kinds",
        "us", **_FIRSTS, **dict(_ASSIGN)),
    "row_label": "SELECT doc_id, CASE WHEN toxic = 1 THEN quality ELSE (quality = 1)::INT END AS label FROM labels",
    "average_precision": sql(
        """SELECT round(sum(pos / tot * (cp / cn)), 9) AS average_precision FROM (
        SELECT pos, sum(pos) OVER () AS tot, sum(pos) OVER w AS cp, sum(n) OVER w AS cn
        FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY score) WINDOW w AS (ORDER BY score DESC))""", None, s=_LABELS),
    "binary_metrics": sql(
        f"""SELECT n, tp, fp, fn, {_prf('tp', 'fp', 'fn')} FROM (SELECT count(*) AS n, count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
        count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM s)""", None, s=_LABELS),
    "clean_fpr": sql(
        """SELECT count(*) AS n_clean, count(*) FILTER (score >= 0.5) AS n_flagged,
        round(count(*) FILTER (score >= 0.5) / count(*), 9) AS clean_fpr FROM s WHERE kind = 'clean'""", None, s=_LABELS),
    "per_type_metrics": sql(
        " UNION ALL ".join(
            f"""SELECT '{k}' AS kind, tp + fn AS n, {_prf('tp', 'fp', 'fn')} FROM (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
            count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn
            FROM s WHERE kind IN ('{k}', 'clean'))""" for k in ("encoding", "truncation")), None, s=_LABELS),
}
