"""A whole retraining run, and the wrapper that validates and cleans."""

import pytest
from dqspark.operators import clean, contract, review
from dqspark.operators.rowfeat import ROW_FEATURES
from pyspark.sql import functions as F


def featured(spark, n, start, bad_share, kind):
    """Rows whose bad ones have many nulls and short names."""
    df = spark.range(start, start + n).withColumnRenamed("id", "k")
    bad = F.pmod(F.xxhash64("k"), F.lit(100)) < int(bad_share * 100)
    noise = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(10)).cast("double")
    features = {f: noise / (i + 1) for i, f in enumerate(ROW_FEATURES)}
    features |= {"null_count": F.when(bad, 5.0).otherwise(0.0) + noise / 10, "name_len": F.when(bad, 2.0).otherwise(20.0) + noise}
    return df.withColumn("label", bad.cast("int")).withColumns(features).withColumn(
        "corruption_type", F.when(bad, kind).otherwise("clean"))


def test_retrain_learns_from_both_and_decides(spark):
    synthetic, human = featured(spark, 1500, 0, 0.2, "null_storm"), featured(spark, 60, 10_000, 0.3, "reviewed")
    out = review.retrain(synthetic, human, "k", 0.5, rounds=3)
    assert out["register"] and out["metrics"]["pr_auc"] > 0.95 and out["metrics"]["recall"] > 0.9
    assert set(out["metrics"]["per_type"]) >= {"null_storm"}
    assert out["human_eval"]["recall"] > 0.9
    assert not review.passes_gate(out["metrics"]["pr_auc"], 2.0)
    scored = out["model"].score(featured(spark, 50, 50_000, 0.5, "x"))
    assert scored.filter((F.col("score") >= 0.5).cast("int") != F.col("label")).count() <= 2
    with pytest.raises(ValueError):
        review.retrain(synthetic, human.limit(0), "k", None)


def test_validate_and_clean_is_all_steps_in_turn(spark, company):
    rows = company({}, {}, {"company_size": "99"}, {"company_id": "2", "name": "  A   B "}, {"company_id": None}, {"company_id": "3", "country": "0"})
    got = {r["company_id"]: r for r in clean.validate_and_clean(rows).collect()}
    assert set(got) == {1, 2, 3} and got[2]["name"] == "A B" and got[3]["country"] is None and got[1]["company_size"] == 3
    by_hand = clean.clean_records(contract.valid_records(contract.annotate(rows)))
    assert sorted(map(str, by_hand.collect())) == sorted(map(str, got.values()))
