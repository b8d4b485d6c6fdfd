"""Results that differ only on larger tables, and steps whose work must not grow faster than the input."""

import string
import unicodedata

import check
import pytest
from pyspark.sql import functions as F

from dqspark.functions import chars
from dqspark.operators import augment, clean, fingerprint, impute, infer, rowfeat
from dqspark.plans import catalog_score, companies, run
from dqspark.sources import durable


@pytest.mark.parametrize("name", ["review_queue"])
def test_rows_equal_on_more_than_a_page(spark, name):
    sf = "/root/testdata/sf0.1"
    ok, note = check.compare(spark, check.database(sf), name, sf)
    assert ok, note


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_odd_texts(spark):
    texts = ["", " \t ", "Ab9 é²٣", "x\x85y  12-3\n", "😀 ÉÉ\x1c1", None, "中文 7", "a" * 300]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r["c"] for r in rows.select("i", chars.counts(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert all(v is None for v in got[i])
            continue
        words = t.split()
        want = (
            len(t), sum(c.isalpha() for c in t), sum(c.isdigit() for c in t), sum(c in string.punctuation for c in t),
            sum(c.isspace() for c in t), sum(unicodedata.category(c) == "Lu" for c in t),
            sum(not (" " <= c <= "~" or "\t" <= c <= "\r") for c in t),
            sum(c.isdigit() and not (k and t[k - 1].isdigit()) for k, c in enumerate(t)), len(words), sum(len(w) ** 2 for w in words),
        )
        assert tuple(got[i]) == want


def test_long_texts_go_through_no_pattern_twice(spark):
    """Cleaning computed each text twice, features asked some hundred ranges for every character."""
    rows = spark.createDataFrame([("a b",)], "description string")
    assert _plan(clean.normalize_text_columns(rows, ["description"])).count("regexp_replace") == 0
    full = spark.createDataFrame([], "company_id bigint, name string, description string, company_size bigint, state string, "
                                 "country string, city string, zip_code string, address string, url string")
    reference = spark.createDataFrame([], "zip3 string, state string, n bigint")
    plan = _plan(rowfeat.row_features(full, reference).select("description_frac_digit"))
    assert "regexp" not in plan


def test_rows_are_cleaned_and_written_once(spark, monkeypatch):
    """Training and scoring each cleaned the feed, and the labeled rows wrote it twice more."""
    calls, written = [], []
    real, pinned = companies.cleaned, durable.pin
    monkeypatch.setattr(companies, "cleaned", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(augment, "pin", lambda df, name="step": written.append((name, df.columns)) or pinned(df, name))
    monkeypatch.setattr(catalog_score, "TREES", 2)
    monkeypatch.setattr(catalog_score, "ROUNDS", 1)
    catalog_score.score_and_route(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1
    assert not [n for n, columns in written if "description" in columns]


def test_fingerprints_are_computed_once_for_their_labels(spark, tmp_path):
    """The check of the labels and the join each computed all fingerprints; numbers went through the search for long texts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def met(value):
        seen.add(1)
        return value

    rows = spark.range(50).coalesce(1).select(F.col("id").cast("string").alias("t")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).select(met("t").alias("t"))
    prints = fingerprint.fingerprint(rows).select(F.lit("a").alias("source"), "*")
    labels = spark.createDataFrame([("a", "t", "identifier")], "source string, column string, label string")
    got = fingerprint.label_fingerprints(prints, labels).collect()
    assert [(r["column"], r["n_rows"], r["label"]) for r in got] == [("t", 50, "identifier")] and seen.value == 50
    assert "sha2" not in _plan(fingerprint.table_values(spark.range(3)))


def test_long_texts_are_not_written_with_every_fill(spark, company, tmp_path, monkeypatch):
    longest, pinned = [], impute.pin

    def spy(df, name="step"):
        if name.startswith("fill-"):
            longest.append(df.agg(F.max(F.length("description"))).first()[0])
        return pinned(df, name)

    monkeypatch.setattr(impute, "pin", spy)
    text = "long " * 200 + "end."
    rows = company(*[{"company_id": str(i), "company_size": str(1 + i % 4), "description": f"{i} {text}", **({"state": None} if i % 3 == 0 else {})} for i in range(9)])
    report = run.run_batch(rows, str(tmp_path / "c"), str(tmp_path / "q"))
    kept = {r["company_id"]: (r["state"], r["description"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert report["written_clean"] == 9 and kept == {i: ("NY", f"{i} {text}") for i in range(9)}
    assert longest and max(longest) <= 128


def test_only_listed_columns_are_read_again(spark):
    rows = spark.createDataFrame([(f"k{i} " * 50, " b" if i % 2 else "a") for i in range(30)], "long string, few string")
    profiled = infer.profile(rows).localCheckpoint()
    found = infer.observed_values(rows, profiled)
    assert [(r["column"], r["observed"]) for r in found.collect()] == [("few", ["a", "b"])]
    assert "long" not in _plan(found).split("LogicalRDD")[0]
    assert infer.observed_values(rows.select("long"), profiled.filter("column = 'long'")).count() == 0
