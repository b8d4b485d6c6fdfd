"""Queries over missing values: diagnosis, strategies, group modes, the engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators import impute, missing
from dqspark.operators.ranking import stratified_split
from dqspark.plans import companies as co
from dqspark.plans.sqltext import quote, sql
from dqspark.sources.durable import pin, shared_folder

TEXTS = ("name", "description", "state", "country", "city", "zip_code", "address", "url")
TARGETS = ("description", "company_size", "state", "country", "city", "zip_code", "address")
NUMBERS = ("company_id", "company_size")
SIZE_PREDICTORS, SIZE_KIND = impute.BENCHMARKED["company_size"]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Records to diagnose; a description is its digest, which has the same nulls and equalities."""
    return pin(co.brief(spark, sf, "company_id", *TEXTS, "company_size"), "records")


def _seq_records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The asked columns of the records, written once."""
    return pin(co.brief(spark, sf, "_seq", *columns).withColumnRenamed("_seq", "seq"), "records")


def missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return missing.missing_profile(_records(spark, sf)).withColumn("missing_ratio", F.round("missing_ratio", 6))


def missing_assoc_numeric(spark: SparkSession, sf: str) -> DataFrame:
    pairs = missing.numeric_associations(_records(spark, sf), list(TARGETS))
    return pairs.select("target", "predictor", F.round("statistic", 6).alias("r"), "n", "missing")


def missing_assoc_chi2(spark: SparkSession, sf: str) -> DataFrame:
    pairs = missing.chi2_associations(_records(spark, sf), list(TARGETS))
    return pairs.select("target", "predictor", F.round("statistic", 6).alias("chi2"), "n", "missing")


def missing_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return missing.diagnose(_records(spark, sf), list(TARGETS)).select("column", "missing_count", "verdict")


def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = _seq_records(spark, sf, "company_size")
    fill = impute.median_of(rows, "company_size").scalar()
    return rows.select("seq", F.coalesce("company_size", fill).alias("company_size"))


def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _seq_records(spark, sf, "country")
    fill = impute.mode_of(rows, "country").scalar()
    return rows.select("seq", F.coalesce("country", fill).alias("country"))


def freq_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _seq_records(spark, sf, "state", "country", "city", "company_id", "company_size")
    encoder = impute.Encoder.fit(rows.filter(F.col("company_size").isNotNull()), ("state", "country", "city", "company_id"))
    return encoder.transform(rows).select("seq", *[F.round(a, 9).alias(a) for a in encoder.axes])


def _strategy(strategy, spark: SparkSession, sf: str, target: str = "company_size") -> DataFrame:
    predictors, _ = impute.BENCHMARKED[target]
    rows = _seq_records(spark, sf, target, *predictors)
    known, holes = rows.filter(F.col(target).isNotNull()), rows.filter(F.col(target).isNull())
    fitted = strategy.fit(known, target, predictors, "seq")
    return fitted.predict(holes).select("seq", F.col("predicted").alias(target))


def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _strategy(impute.KNearest(), spark, sf)


def impute_ridge(spark: SparkSession, sf: str) -> DataFrame:
    return _strategy(impute.Ridge(), spark, sf)


def impute_trees(spark: SparkSession, sf: str) -> DataFrame:
    return _strategy(impute.Trees(), spark, sf)


def impute_trees_cities(spark: SparkSession, sf: str) -> DataFrame:
    """What the boosted trees fill in where the city, which fixes the size in this feed, is known."""
    target, predictors = "company_size", SIZE_PREDICTORS
    rows = _seq_records(spark, sf, target, *predictors)
    fitted = impute.Trees().fit(rows.filter(F.col(target).isNotNull()), target, predictors, "seq")
    holes = rows.filter(F.col(target).isNull() & F.col("city").isNotNull())
    return fitted.predict(holes).select("seq", "city", F.col("predicted").alias(target))


def impute_trees_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out macro-F1 of the baseline, the rows it is measured on, and whether boosted trees beat it."""
    known = _seq_records(spark, sf, "company_size", *SIZE_PREDICTORS).filter(F.col("company_size").isNotNull())
    result = impute.benchmark(
        known, "company_size", SIZE_PREDICTORS, SIZE_KIND, "seq", [impute.Baseline("median"), impute.Trees()])
    split = stratified_split(known, "company_size", "seq", impute.TEST_SHARE, impute.SEED)
    baseline, boosted = result["scores"]["median"], result["scores"]["boosted"]
    return split.agg(
        F.count_if("is_test").alias("rows"), F.lit(round(baseline, 9)).alias("baseline_f1"), F.lit(boosted > baseline).alias("boosted_is_better"))


def engine_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """What the engine fills in where it chooses between a baseline and boosted trees and the city settles the value."""
    rows = _seq_records(spark, sf, "company_size", "country", "state", "city", "zip_code")
    rivals = {"company_size": [impute.Baseline("median"), impute.Trees()], "country": [impute.Baseline("mode"), impute.Trees()]}
    filled, report = impute.run_engine(rows, "seq", rivals)
    asked = rows.filter((F.col("company_size").isNull() | F.col("country").isNull()) & F.col("city").isNotNull()).select("seq", "city")
    winners = report.filter("decision = 'benchmarked'").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "column", "winner"))), " ").alias("winners"))
    return asked.join(filled.select("seq", "company_size", "country"), "seq").crossJoin(F.broadcast(winners))


def impute_stored_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Models fitted on three quarters of the records, stored, read back and applied to the others without a refit."""
    rows = _seq_records(spark, sf, "company_size", "country", "state", "city", "zip_code")
    first, later = rows.filter("seq % 4 <> 0"), rows.filter("seq % 4 = 0")
    plain = {"company_size": [impute.Baseline("median")], "country": [impute.Baseline("mode")]}
    folder = f"{shared_folder(spark)}/imputers-{uuid.uuid4().hex}"
    impute.run_engine(first, "seq", plain, impute.ImputerStore(spark, folder))
    filled, report = impute.ImputerStore(spark, folder).apply(later)
    versions = report.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "column", "winner", "model_version"))), " ").alias("versions"))
    return filled.crossJoin(F.broadcast(versions))


def impute_learned_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows each learned strategy fills, and how many of them with a known class."""
    rows = _seq_records(spark, sf, "company_size", *SIZE_PREDICTORS)
    known, holes = rows.filter(F.col("company_size").isNotNull()), rows.filter(F.col("company_size").isNull())
    classes = known.select(F.col("company_size").alias("predicted")).distinct().withColumn("is_known", F.lit(True))
    out = None
    for strategy in (impute.KNearest(), impute.Ridge(), impute.Trees()):
        filled = strategy.fit(known, "company_size", SIZE_PREDICTORS, "seq").predict(holes)
        part = filled.join(F.broadcast(classes), "predicted", "left").agg(
            F.lit(strategy.name).alias("strategy"), F.count(F.lit(1)).alias("rows"), F.count_if("is_known").alias("known"),
            F.countDistinct("seq").alias("keys"),
        )
        out = part if out is None else out.unionAll(part)
    return out


def engine_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What the engine decides for each column, with the baselines as strategies."""
    plain = {"company_size": [impute.Baseline("median")], "country": [impute.Baseline("mode")]}
    _, report = impute.run_engine(_records(spark, sf), "company_id", plain)
    return report.select("column", "decision", "missing_count", "diagnosis", "winner")


def impute_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    rows = _seq_records(spark, sf, "company_size", *SIZE_PREDICTORS)
    known = rows.filter(F.col("company_size").isNotNull())
    result = impute.benchmark(known, "company_size", SIZE_PREDICTORS, SIZE_KIND, "seq")
    scores = [(k, float(v), k == result["winner"]) for k, v in result["scores"].items()]
    return spark.createDataFrame(scores, "strategy string, macro_f1 double, winner boolean")


def impute_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """The deterministic part of the benchmark: both baselines on their columns."""
    from dqspark.operators.metrics import macro_f1
    rows = _seq_records(spark, sf, "company_size", "country")
    out = None
    for target, name in (("company_size", "median"), ("country", "mode")):
        known = rows.filter(F.col(target).isNotNull()).select("seq", target)
        split = stratified_split(known, target, "seq", impute.TEST_SHARE, impute.SEED)
        fitted = impute.Baseline(name).fit(split.filter(~F.col("is_test")), target, (), "seq")
        score = macro_f1(fitted.predict(split.filter("is_test")), target, "predicted")
        part = score.select(F.lit(target).alias("column"), F.lit(name).alias("strategy"), F.round("macro_f1", 9).alias("macro_f1"))
        out = part if out is None else out.unionByName(part)
    return out


def class_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _seq_records(spark, sf, "company_size", "country", "city", "zip_code", "name")
    parts = [
        impute.class_coverage(rows, c).select(F.lit(c).alias("column"), "*")
        for c in ("company_size", "country", "city", "zip_code", "name")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("coverage_ratio", F.round("coverage_ratio", 6))


def group_mode_fit(spark: SparkSession, sf: str) -> DataFrame:
    return impute.fit_group_mode(_seq_records(spark, sf, "zip_code", "state", "country"), "zip_code", ("state", "country"))


def group_mode_fill(spark: SparkSession, sf: str) -> DataFrame:
    return impute.fill_group_mode(_seq_records(spark, sf, "state", "country"), "state", ("country",))


def group_mode_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _seq_records(spark, sf, "state", "country", "city", "zip_code")
    parts = [
        impute.group_mode_coverage(rows, c, g).select(F.lit(c).alias("column"), "*")
        for c, g in impute.GROUP_MODE.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("hit_rate", F.round("hit_rate", 6))


def impute_geo_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = _seq_records(spark, sf, "state", "country", "city", "zip_code")
    for target, groups in impute.GROUP_MODE.items():
        rows = pin(impute.fill_group_mode(rows, target, groups), f"geo-{target}")
    return rows


def impute_engine(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the whole engine over the cleaned records."""
    _, report = impute.run_engine(_records(spark, sf))
    return report


QUERIES = {
    "missing_profile": missing_profile,
    "missing_assoc_numeric": missing_assoc_numeric,
    "missing_assoc_chi2": missing_assoc_chi2,
    "missing_verdict": missing_verdict,
    "impute_median": impute_median,
    "impute_mode": impute_mode,
    "freq_encode": freq_encode,
    "class_coverage": class_coverage,
    "group_mode_fit": group_mode_fit,
    "group_mode_fill": group_mode_fill,
    "group_mode_coverage": group_mode_coverage,
    "impute_geo_chain": impute_geo_chain,
    "impute_baselines": impute_baselines,
    "impute_knn": impute_knn,
    "impute_ridge": impute_ridge,
    "impute_trees": impute_trees,
    "impute_trees_cities": impute_trees_cities,
    "impute_trees_gain": impute_trees_gain,
    "impute_stored_batch": impute_stored_batch,
    "engine_rivals": engine_rivals,
    "impute_benchmark": impute_benchmark,
    "impute_engine": impute_engine,
    "impute_learned_rows": impute_learned_rows,
    "engine_decisions": engine_decisions,
}

_PAIRS = [(t, p) for p in NUMBERS for t in TARGETS if t != p]
_NUMERIC = " UNION ALL ".join(
    f"""SELECT '{t}' AS target, '{p}' AS predictor, corr(({t} IS NULL)::INT, {p}) AS r,
    count({p}) AS n, count({p}) FILTER ({t} IS NULL) AS missing FROM cln""" for t, p in _PAIRS
)
_CELLS = " UNION ALL ".join(
    f"""SELECT '{t}' AS target, '{p}' AS predictor, {p} AS value, count(*) AS n, count(*) FILTER ({t} IS NULL) AS m
    FROM cln WHERE {p} IS NOT NULL GROUP BY {p}""" for t in TARGETS for p in TEXTS if t != p
)
_TABLES = """
SELECT *, sum(n) OVER w AS rows, sum(m) OVER w AS ms, count(*) OVER w AS k FROM cells
WINDOW w AS (PARTITION BY target, predictor)"""


def _part(obs: str, margin: str) -> str:
    e = f"(n::DOUBLE * {margin} / rows)"
    gap = f"abs({obs} - {e})"
    gap = f"(CASE WHEN k = 2 THEN {gap} - least(0.5, {gap}) ELSE {gap} END)"
    return f"{gap} * {gap} / {e}"


_CHI2 = f"""
SELECT target, predictor, sum({_part('m', 'ms')} + {_part('(n - m)', '(rows - ms)')}) AS chi2,
  CAST(max(rows) AS BIGINT) AS n, CAST(max(ms) AS BIGINT) AS missing, max(k) - 1 AS df
FROM tables WHERE k BETWEEN 2 AND 50 AND ms BETWEEN 1 AND rows - 1 GROUP BY target, predictor"""


# Upper 5% points of chi-square for 1 to 49 degrees of freedom, from printed tables.
CHI2_95 = (
    3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685, 24.996,
    26.296, 27.587, 28.869, 30.144, 31.410, 32.671, 33.924, 35.172, 36.415, 37.652, 38.885, 40.113, 41.337, 42.557, 43.773,
    44.985, 46.194, 47.400, 48.602, 49.802, 50.998, 52.192, 53.384, 54.572, 55.758, 56.942, 58.124, 59.304, 60.481, 61.656,
    62.830, 64.001, 65.171, 66.339,
)
_CRIT = "SELECT * FROM (VALUES " + ", ".join(f"({d}, {x})" for d, x in enumerate(CHI2_95, 1)) + ") AS c(df, bound)"
# 97.5% point of Student's t from the normal one, to 1/v^2
_T = "(1.959963984540054 + (1.959963984540054 ^ 3 + 1.959963984540054) / (4 * (n - 2)) + (5 * 1.959963984540054 ^ 5 + 16 * 1.959963984540054 ^ 3 + 3 * 1.959963984540054) / (96 * (n - 2) ^ 2))"
_FOUND = f"""
SELECT target FROM chi JOIN crit ON chi.df = crit.df WHERE chi2 > bound
UNION SELECT target FROM num WHERE n >= 3 AND missing BETWEEN 1 AND n - 1
  AND abs(r) * sqrt((n - 2) / greatest(1e-300, (1 - r) * (1 + r))) > {_T}"""
_ALL = ("company_id", *TEXTS, "company_size")
_HOLES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, count(*) AS total FROM cln" for c in _ALL
)


def _mode(target: str, groups: str, table: str) -> str:
    cond = " AND ".join(f"{g.strip()} IS NOT NULL" for g in groups.split(","))
    return f"""SELECT {groups}, arg_min({target}, (-c, {target})) AS mode, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT {groups}, {target}, count(*) AS c FROM {table} WHERE {target} IS NOT NULL AND {cond} GROUP BY ALL) GROUP BY {groups}"""


def _top(target: str, table: str) -> str:
    return f"(SELECT arg_min({target}, (-c, {target})) FROM (SELECT {target}, count(*) AS c FROM {table} WHERE {target} IS NOT NULL GROUP BY ALL))"


def _filled(target: str, groups: str, table: str, keep: str) -> str:
    on = " AND ".join(f"t.{g.strip()} = l.{g.strip()}" for g in groups.split(","))
    cols = ", ".join(f"t.{c.strip()}" for c in keep.split(","))
    return f"""SELECT {cols}, coalesce(t.{target}, l.mode, {_top(target, table)}) AS {target}
    FROM {table} t LEFT JOIN ({_mode(target, groups, table)}) l ON {on}"""


def _share(col: str, table: str) -> str:
    return f"(SELECT {col} AS v, count(*) / (SELECT count({col}) FROM {table}) AS s FROM {table} WHERE {col} IS NOT NULL GROUP BY {col})"


_ENCODED = f"""
SELECT t._seq, t.company_size, coalesce(a.s, 0.0) AS x_state, coalesce(b.s, 0.0) AS x_country, coalesce(c.s, 0.0) AS x_city,
  t.company_id::DOUBLE AS x_company_id
FROM cln t LEFT JOIN {_share('state', 'known')} a ON t.state = a.v LEFT JOIN {_share('country', 'known')} b ON t.country = b.v
LEFT JOIN {_share('city', 'known')} c ON t.city = c.v"""
_KNOWN = "SELECT * FROM cln WHERE company_size IS NOT NULL"


def _split_sql(target: str) -> str:
    return f"""SELECT {target} AS y, row_number() OVER (PARTITION BY {target} ORDER BY md5('42|' || _seq::VARCHAR), _seq)
      <= least(greatest(1, round_even(0.2 * count(*) OVER (PARTITION BY {target}), 0)),
               count(*) OVER (PARTITION BY {target}) - 1) AS t FROM cln WHERE {target} IS NOT NULL"""


def _f1(split: str, fill: str) -> str:
    return f"""SELECT avg(CASE WHEN s + p = 0 THEN 0.0 ELSE 2.0 * h / (s + p) END) FROM (
      SELECT label, count(*) FILTER (y = label) AS s, count(*) FILTER ({fill} = label) AS p,
        count(*) FILTER (y = label AND {fill} = label) AS h
      FROM (SELECT DISTINCT y AS label FROM {split} WHERE t UNION SELECT {fill}), (SELECT y FROM {split} WHERE t) GROUP BY label)"""


_CENTRED = "SELECT n, m1, m2, m3, my, " + ", ".join(
    f"sum(({a} - m{a[1]}) * ({b} - m{b[1]})) AS {n}" for a, b, n in (
        ("x1", "x1", "a11"), ("x2", "x2", "a22"), ("x3", "x3", "a33"), ("x1", "x2", "a12"), ("x1", "x3", "a13"), ("x2", "x3", "a23"),
        ("x1", "yy", "b1"), ("x2", "yy", "b2"), ("x3", "yy", "b3"), ("yy", "yy", "q"))
) + " FROM pts, avgs GROUP BY n, m1, m2, m3, my"
# one step of the evidence: the weights solve the normal equations at the penalty reached so far
_STEP = """
SELECT *, q - 2 * (w1 * b1 + w2 * b2 + w3 * b3) + a11 * w1 * w1 + a22 * w2 * w2 + a33 * w3 * w3
    + 2 * (a12 * w1 * w2 + a13 * w1 * w3 + a23 * w2 * w3) AS r, 3 - rho * (i11 + i22 + i33) AS d FROM (
  SELECT *, i11 * b1 + i12 * b2 + i13 * b3 AS w1, i12 * b1 + i22 * b2 + i23 * b3 AS w2, i13 * b1 + i23 * b2 + i33 * b3 AS w3 FROM (
    SELECT *, (c22 * c33 - a23 * a23) / det AS i11, (c11 * c33 - a13 * a13) / det AS i22, (c11 * c22 - a12 * a12) / det AS i33,
      (a13 * a23 - a12 * c33) / det AS i12, (a12 * a23 - a13 * c22) / det AS i13, (a12 * a13 - a23 * c11) / det AS i23 FROM (
      SELECT *, c11 * (c22 * c33 - a23 * a23) - a12 * (a12 * c33 - a13 * a23) + a13 * (a12 * a23 - a13 * c22) AS det FROM (
        SELECT *, a11 + rho AS c11, a22 + rho AS c22, a33 + rho AS c33 FROM (SELECT s.*, g.*, weight / noise AS rho FROM {state} s, g)))))"""
_EVIDENCE = f"""
SELECT w1, w2, w3 FROM (WITH RECURSIVE st AS (
  SELECT 0 AS i, 1 / (q / n + 2.220446049250313e-16) AS noise, 1.0::DOUBLE AS weight FROM g
  UNION ALL SELECT i + 1, (n - d + 2e-6) / (greatest(r, 0) + 2e-6), (d + 2e-6) / (w1 * w1 + w2 * w2 + w3 * w3 + 2e-6)
  FROM ({_STEP.format(state='st')}) WHERE i < 300) {_STEP.format(state='(SELECT * FROM st ORDER BY i DESC LIMIT 1)')})"""


def _stored(target: str, groups: str, keep: str, source: str, learned: str) -> str:
    """``source`` filled with the modes of ``learned``."""
    on = " AND ".join(f"t.{g.strip()} = l.{g.strip()}" for g in groups.split(","))
    cols = ", ".join(f"t.{c.strip()}" for c in keep.split(","))
    return f"""SELECT {cols}, coalesce(t.{target}, l.mode, {_top(target, learned)}) AS {target}
    FROM {source} t LEFT JOIN ({_mode(target, groups, learned)}) l ON {on}"""


def _plain_fill(source: str) -> str:
    return f"""SELECT seq, state, city, zip_code, coalesce(company_size, (SELECT CAST(round_even(median(company_size), 0) AS BIGINT) FROM one)) AS company_size,
    coalesce(country, {_top('country', 'one')}) AS country FROM {source}"""


_KEEP_STATE, _KEEP_CITY, _KEEP_ZIP = (", ".join(("seq", "company_size", "country", *r)) for r in (("city", "zip_code"), ("state", "zip_code"), ("state", "city")))

ORACLE = {
    "impute_ridge": sql(
        """SELECT seq, 1 + CAST(least(greatest(round_even(code, 0), 0), 6) AS BIGINT) AS company_size FROM (
        SELECT _seq AS seq, my + (x_state - m1) * w1 + (x_country - m2) * w2 + (x_city - m3) * w3 AS code
        FROM enc, avgs, wts WHERE company_size IS NULL)""",
        known=_KNOWN, enc=_ENCODED,
        pts="SELECT x_state AS x1, x_country AS x2, x_city AS x3, (company_size - 1)::DOUBLE AS yy FROM enc WHERE company_size IS NOT NULL",
        avgs="SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(yy) AS my FROM pts",
        g=_CENTRED.replace("myy", "my"), wts=_EVIDENCE),
    "impute_trees_cities": sql(
        """SELECT _seq AS seq, city, 1 + CAST(substr(city, 6) AS BIGINT) % 7 AS company_size FROM cln
        WHERE company_size IS NULL AND city IS NOT NULL"""),
    "impute_trees_gain": sql(
        f"""SELECT count(*) FILTER (t) AS rows, round(({_f1('a', '(SELECT v FROM fa)')}), 9) AS baseline_f1, true AS boosted_is_better FROM a""",
        a=_split_sql("company_size"), fa="SELECT CAST(round_even(median(y), 0) AS BIGINT) AS v FROM a WHERE NOT t"),
    "engine_rivals": sql(
        """SELECT _seq AS seq, city, coalesce(company_size, 1 + n_nationkey % 7) AS company_size,
        coalesce(country, CASE WHEN n_regionkey <= 2 THEN 'US' WHEN n_regionkey = 3 THEN 'GB' ELSE 'DE' END) AS country,
        'company_size:boosted country:boosted' AS winners
        FROM cln JOIN nation ON n_nationkey = CAST(substr(city, 6) AS INT) WHERE company_size IS NULL OR country IS NULL"""),
    "impute_stored_batch": sql(
        """SELECT *, 'city:group_mode:1 company_size:median:1 country:mode:1 state:group_mode:1 zip_code:group_mode:1' AS versions FROM l3""",
        base="SELECT _seq AS seq, company_size, country, state, city, zip_code FROM cln", one="SELECT * FROM base WHERE seq % 4 <> 0",
        two="SELECT * FROM base WHERE seq % 4 = 0", f0=_plain_fill("one"), l0=_plain_fill("two"),
        f1=_filled("state", "country", "f0", _KEEP_STATE), l1=_stored("state", "country", _KEEP_STATE, "l0", "f0"),
        f2=_filled("city", "state, country", "f1", _KEEP_CITY), l2=_stored("city", "state, country", _KEEP_CITY, "l1", "f1"),
        l3=_stored("zip_code", "state, country", _KEEP_ZIP, "l2", "f2")),
    "missing_profile": sql('SELECT "column", missing_count, round(missing_count / total, 6) AS missing_ratio FROM h', h=_HOLES),
    "missing_assoc_numeric": sql(
        "SELECT target, predictor, round(r, 6) AS r, n, missing FROM num WHERE n >= 2 AND missing BETWEEN 1 AND n - 1", num=_NUMERIC),
    "missing_assoc_chi2": sql(
        "SELECT target, predictor, round(chi2, 6) AS chi2, n, missing FROM chi", cells=_CELLS, tables=_TABLES, chi=_CHI2),
    "missing_verdict": sql(
        f"""SELECT "column", missing_count, CASE WHEN "column" IN (SELECT target FROM found) THEN {quote(missing.MAR)}
        ELSE {quote(missing.MCAR)} END AS verdict FROM h WHERE missing_count > 0""",
        cells=_CELLS, tables=_TABLES, chi=_CHI2, num=_NUMERIC, crit=_CRIT, found=_FOUND, h=_HOLES),
    "impute_learned_rows": sql(" UNION ALL ".join(
        f"SELECT '{s}' AS strategy, count(*) AS rows, count(*) AS known, count(DISTINCT _seq) AS keys FROM cln WHERE company_size IS NULL"
        for s in ("knn", "ridge", "boosted"))),
    "engine_decisions": sql(
        f"""SELECT "column", CASE WHEN "column" IN ('company_size', 'country') THEN 'benchmarked'
        WHEN "column" IN ('description', 'address') THEN 'left null on purpose' WHEN "column" = 'state' THEN 'most frequent value per country'
        WHEN "column" IN ('city', 'zip_code') THEN 'most frequent value per state + country'
        ELSE 'left null: nothing set up for this column' END AS decision, missing_count,
        CASE WHEN "column" IN (SELECT target FROM found) THEN {quote(missing.MAR)} ELSE {quote(missing.MCAR)} END AS diagnosis,
        CASE "column" WHEN 'company_size' THEN 'median' WHEN 'country' THEN 'mode' END AS winner
        FROM h WHERE missing_count > 0""",
        cells=_CELLS, tables=_TABLES, chi=_CHI2, num=_NUMERIC, crit=_CRIT, found=_FOUND, h=_HOLES),
    "impute_median": sql(
        """SELECT _seq AS seq, coalesce(company_size, (SELECT CAST(round_even(median(company_size), 0) AS BIGINT) FROM cln))
        AS company_size FROM cln"""),
    "impute_mode": sql(f"SELECT _seq AS seq, coalesce(country, {_top('country', 'cln')}) AS country FROM cln"),
    "freq_encode": sql(
        """SELECT _seq AS seq, round(x_state, 9) AS x_state, round(x_country, 9) AS x_country, round(x_city, 9) AS x_city,
        x_company_id FROM enc""", known=_KNOWN, enc=_ENCODED),
    "class_coverage": sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS total_classes, count(*) FILTER (n >= 2) AS evaluated_classes,
            count(*) FILTER (n < 2) AS singleton_classes, round(count(*) FILTER (n >= 2) / count(*), 6) AS coverage_ratio
            FROM (SELECT count(*) AS n FROM cln WHERE {c} IS NOT NULL GROUP BY {c})"""
            for c in ("company_size", "country", "city", "zip_code", "name"))),
    "group_mode_fit": sql(_mode("zip_code", "state, country", "cln")),
    "group_mode_fill": sql(
        "SELECT seq, country, state FROM f", s="SELECT _seq AS seq, state, country FROM cln",
        f=_filled("state", "country", "s", "seq, country")),
    "group_mode_coverage": sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS missing, count(l.mode) AS group_hits,
            round(count(l.mode) / count(*), 6) AS hit_rate FROM (SELECT * FROM cln WHERE {c} IS NULL) t
            LEFT JOIN ({_mode(c, ', '.join(g), 'cln')}) l ON {' AND '.join(f't.{x} = l.{x}' for x in g)}"""
            for c, g in impute.GROUP_MODE.items())),
    "impute_geo_chain": sql(
        "SELECT seq, state, country, city, zip_code FROM g3",
        g0="SELECT _seq AS seq, state, country, city, zip_code FROM cln",
        g1=_filled("state", "country", "g0", "seq, country, city, zip_code"),
        g2=_filled("city", "state, country", "g1", "seq, state, country, zip_code"),
        g3=_filled("zip_code", "state, country", "g2", "seq, state, country, city")),
    "impute_baselines": sql(
        f"""SELECT 'company_size' AS "column", 'median' AS strategy, round(({_f1('a', '(SELECT v FROM fa)')}), 9) AS macro_f1
        UNION ALL SELECT 'country', 'mode', round(({_f1('b', '(SELECT v FROM fb)')}), 9)""",
        a=_split_sql("company_size"), b=_split_sql("country"),
        fa="SELECT CAST(round_even(median(y), 0) AS BIGINT) AS v FROM a WHERE NOT t",
        fb="SELECT arg_min(y, (-c, y)) AS v FROM (SELECT y, count(*) AS c FROM b WHERE NOT t GROUP BY y)"),
    "impute_knn": sql(
        """SELECT seq, CAST(code AS BIGINT) AS company_size FROM (
        SELECT q._seq AS seq, round_even(avg(n.company_size - 1), 0) + 1 AS code FROM enc q,
        LATERAL (SELECT e.company_size FROM enc e WHERE e.company_size IS NOT NULL
          ORDER BY (q.x_state - e.x_state) * (q.x_state - e.x_state) + (q.x_country - e.x_country) * (q.x_country - e.x_country)
            + (q.x_city - e.x_city) * (q.x_city - e.x_city), md5('42|' || e._seq::VARCHAR) LIMIT 5) n
        WHERE q.company_size IS NULL GROUP BY q._seq)""", known=_KNOWN, enc=_ENCODED),
}
