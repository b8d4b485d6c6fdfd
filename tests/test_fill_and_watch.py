import random

import pytest
from pyspark.sql import functions as F

from dqspark.functions import tails
from dqspark.operators import collide, drift, impute, missing, neighbors, quarantine, report, review


def test_tails_against_known_values(spark):
    known = [(3.841458820694124, 1.0, 0.05), (18.307038053275146, 10.0, 0.05), (100.0, 3.0, 1.5530e-21), (0.0, 4.0, 1.0), (-1.0, 2.0, 1.0)]
    for r in spark.createDataFrame(known, "x double, d double, p double").select("p", tails.chi2_p("x", "d").alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], rel=1e-3)
    known = [(2.2281388519649385, 10.0, 0.05), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (float("inf"), 5.0, 0.0), (1.0, 0.0, None), (float("nan"), 3.0, None)]
    for r in spark.createDataFrame(known, "x double, d double, p double").select("p", tails.t_p(F.col("x"), F.col("d")).alias("q")).collect():
        assert r["q"] == (None if r["p"] is None else pytest.approx(r["p"], abs=1e-9))


def test_skipped_predictors_are_listed(spark):
    df = spark.createDataFrame([(f"v{i}", "one", "ab"[i % 2]) for i in range(60)], "many string, one string, two string")
    got = {r["predictor"]: r["reason"] for r in missing.skipped_predictors(df).collect()}
    assert got == {"many": "more than 50 values", "one": "fewer than two values"}
    assert missing.skipped_predictors(df, 60).count() == 1


@pytest.mark.parametrize("dims,rows,seed", [(1, 60, 1), (3, 400, 2), (4, 300, 3)])
def test_nearest_equals_brute_force(spark, dims, rows, seed):
    rng = random.Random(seed)
    axes = [f"x{i}" for i in range(dims)]
    point = lambda: [rng.choice([0.0, 0.001, rng.random() ** 4, rng.random() * 3]) for _ in axes]
    train = [(*point(), float(rng.randrange(7)), f"{i:05d}") for i in range(rows)]
    queries = [tuple(point()) for _ in range(80)] + [t[:dims] for t in train[:20]]
    schema = ", ".join(f"{a} double" for a in axes)
    got = {tuple(r[a] for a in axes): r["mean"] for r in neighbors.nearest(
        spark.createDataFrame(train, schema + ", v double, o string"), spark.createDataFrame(queries, schema), axes, "v", "o").collect()}
    assert len(got) == len(set(queries))
    for q in queries:
        best = sorted((sum((a - b) * (a - b) for a, b in zip(q, t)), t[-1], t[-2]) for t in train)[:5]
        assert got[q] == pytest.approx(sum(b[2] for b in best) / 5), q


def test_nearest_with_few_rows(spark):
    train = spark.createDataFrame([(0.1, 1.0, "a"), (900.0, 3.0, "b")], "x double, v double, o string")
    got = neighbors.nearest(train, spark.createDataFrame([(0.1,), (5.0,)], "x double"), ["x"], "v", "o").collect()
    assert len(got) == 2 and {r["mean"] for r in got} == {2.0}


def test_diagnosis(spark):
    mar = [("a" if i < 30 else "b", None if i < 24 else 1, i % 3) for i in range(60)]
    df = spark.createDataFrame(mar, "g string, y int, z int")
    row = missing.diagnose(df, ["y"]).first()
    assert (row["missing_count"], row["missing_ratio"], row["verdict"]) == (24, 0.4, missing.MAR)
    mcar = [("ab"[i % 2], None if i % 4 < 2 else 1) for i in range(120)]
    assert missing.diagnose(spark.createDataFrame(mcar, "g string, y int"), ["y"]).first()["verdict"] == missing.MCAR


def test_group_mode(spark):
    df = spark.createDataFrame(
        [("US", "NY"), ("US", "NY"), ("US", "CA"), ("US", None), ("GB", "X"), ("FR", None), (None, None), (None, "Z")], "country string, state string")
    got = [(r["country"], r["state"]) for r in impute.fill_group_mode(df, "state", ("country",)).collect()]
    assert sorted(got, key=str)[:3] == sorted([("FR", "NY"), ("GB", "X"), (None, "NY")], key=str)[:3] or ("FR", "NY") in got
    assert got.count(("US", "NY")) == 3 and (None, "NY") in got and (None, "Z") in got
    assert impute.group_mode_coverage(df, "state", ("country",)).first()["hit_rate"] == pytest.approx(1 / 3)


def test_benchmark_prefers_signal_over_the_baseline(spark):
    rows = [(i, "east" if i % 2 else "west", 1 + 5 * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, region string, code bigint")
    # both regions are equally frequent, so only the trees can tell them apart
    strategies = [impute.Baseline("median"), impute.Ridge(), impute.Trees(rounds=5, depth=3)]
    result = impute.benchmark(df, "code", ("region",), "ordinal", "id", strategies)
    assert result["winner"] == "boosted" and result["scores"]["boosted"] == 1.0
    assert result["class_coverage"]["singleton_classes"] == 0 and impute.limitation(result["class_coverage"]) is None


def test_psi_and_ks(spark):
    def counts(d):
        return spark.createDataFrame(list(d.items()), "bucket string, count bigint")

    same = {"a": 100, "b": 200}
    assert drift.psi(counts(same), counts(same)).first()["psi"] == 0.0
    moved = drift.psi(counts({"a": 500, "b": 500}), counts({"a": 500, "c": 500})).first()
    assert moved["severity"] == "significant" and moved["psi"] > 1
    assert drift.psi(counts(same), counts({"a": 0})).first()["psi"] is None
    a, b = spark.range(100).select(F.col("id").alias("v")), spark.range(500, 600).select(F.col("id").alias("v"))
    far, near = drift.ks_of_values(a, b, "v").first(), drift.ks_of_values(a, a, "v").first()
    assert far["statistic"] == 1.0 and far["severity"] == "significant"
    assert near["statistic"] == 0.0 and near["p_value"] == 1.0 and near["severity"] == "none"


def test_profile_round_trip_and_report(spark, tmp_path):
    rows = [(str(i % 7 + 1) if i % 9 else None, "NY" if i % 5 else None, "x" * (i % 40) if i % 8 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "company_size string, state string, description string")
    drift.save_profile(drift.build_profile(df), str(tmp_path / "p"))
    profile = drift.load_profile(spark, str(tmp_path / "p"))
    same = drift.check_drift(profile, drift.build_profile(df)).collect()
    assert len(same) == 3 and not any(r["any_flagged"] for r in same)
    shifted = df.withColumn("state", F.when(F.rand(1) < 0.4, F.col("state")))
    found = {r["metric"]: r for r in drift.check_drift(profile, drift.build_profile(shifted)).collect()}
    assert found["state_null_rate"]["severity"] == "significant" and found["company_size"]["any_flagged"]


def test_gate_and_unlock(spark):
    assert review.passes_gate(0.5, None) and review.passes_gate(0.98, 0.985) and not review.passes_gate(0.97, 0.985)
    rows = spark.createDataFrame([(i, "confirmed_bad" if i else "false_positive") for i in range(20)], "record_id bigint, decision string")
    got = review.review_progress(rows).first()
    assert (got["confirmed_bad"], got["false_positive"], got["total"], got["retrain_unlocked"]) == (19, 1, 20, True)


def test_only_model_flags_with_features_are_reviewable(spark):
    schema = "id bigint, raw_data string, reasons " + __import__("dqspark.operators.contract", fromlist=["x"]).REASONS_TYPE + ", quarantined_at timestamp"
    import datetime
    at = datetime.datetime(2024, 1, 1)
    rows = [
        (1, "{}", [("url", "m", "error", None, None, None)], at),
        (2, '{"company_id": 5}', [("url", "m", "error", None, None, None), (quarantine.RULE, "m", "warning", "1", 0.9, {"a": 1.0})], at),
        (3, "{}", [(quarantine.RULE, "m", "warning", "1", 0.9, None)], at),
        (4, "{}", [(quarantine.RULE, "m", "warning", "1", 0.8, {"a": 2.0})], at),
    ]
    records = spark.createDataFrame(rows, schema)
    reviews = spark.createDataFrame([(4, "false_positive"), (2, "confirmed_bad")], "record_id bigint, decision string")
    assert [r["record_id"] for r in review.review_queue(records, reviews.filter("record_id = 4")).collect()] == [2]
    labels = {r["record_id"]: (r["company_id"], r["label"], r["corruption_type"]) for r in review.reviewed_labels(records, reviews).collect()}
    assert labels == {2: ("5", 1, "human_confirmed_bad"), 4: (None, 0, "human_false_positive")}
    assert {r["rule"]: r["count"] for r in report.latest_reasons(records).collect()} == {quarantine.RULE: 3, "url": 2}


def test_caveat_and_empty_run(spark):
    df = spark.createDataFrame([(0, 5), (2, 5)], "s bigint, e bigint")
    got = [r[0] for r in df.select(report.coverage_caveat(F.col("s"), F.col("e"))).collect()]
    assert got[0] is None and got[1].startswith("untested: 2 of 7 values")
    empty = spark.createDataFrame([], "loaded_at timestamp, quarantined_at timestamp")
    assert report.latest_run(empty, empty).count() == 0


def test_names_collide_without_legal_forms(spark):
    rows = [(1, "Johnson & Johnson"), (2, "Johnson & Johnson, Inc."), (3, "Merck"), (4, "MERCK Group Holdings LLC"), (5, "Other"), (5, "other inc")]
    got = {r["bare_name"]: r["keys"] for r in collide.name_collisions(spark.createDataFrame(rows, "id bigint, name string"), "name", "id").collect()}
    assert got == {"johnson johnson": 2, "merck": 2} or got == {"johnson  johnson": 2, "merck": 2}
