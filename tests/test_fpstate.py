"""Stored fingerprint states against fresh scans, and stored labels."""

import pytest
from dqspark.operators import fingerprint
from dqspark.operators.fpstate import FingerprintStore
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, ids):
    rows = [(i % 7, f"name {i % 5}" if i % 3 else None, "long text " * (i % 20) + str(i % 4)) for i in ids]
    return spark.createDataFrame(rows, "a int, b string, c string")


def test_state_and_batch_equal_a_fresh_scan(spark, tmp_path):
    store = FingerprintStore(spark, str(tmp_path))
    parts = [table(spark, r) for r in (range(40), range(35, 90), range(0), range(200, 230))]
    whole = parts[0]
    store.add("t", parts[0], "first")
    for i, p in enumerate(parts[1:]):
        store.add("t", p)
        whole = whole.unionAll(p)
        if i == 1:
            store.compact("t")
    got = FingerprintStore(spark, str(tmp_path)).fingerprints("t")
    assert rows_of(got.drop("source")) == rows_of(fingerprint.fingerprint(whole))
    assert {r["source"] for r in got.collect()} == {"t"}
    with pytest.raises(ValueError):
        store.add("t", parts[0], "first")
    assert rows_of(store.fingerprints("t")) == rows_of(got)
    with pytest.raises(KeyError):
        store.values("other")


def test_labels_are_saved_and_replaced(spark, tmp_path):
    store = FingerprintStore(spark, str(tmp_path))
    store.add("t", table(spark, range(30)))
    labels = spark.createDataFrame([("a", "identifier"), ("b", "free_text")], "column string, label string")
    store.save_labels("t", labels)
    store.save_labels("t", labels.withColumn("label", F.when(F.col("column") == "a", "categorical").otherwise(F.col("label"))))
    out = {r["column"]: r["label"] for r in FingerprintStore(spark, str(tmp_path)).labeled("t").collect()}
    assert out == {"a": "categorical", "b": "free_text"}
    with pytest.raises(KeyError):
        store.save_labels("t", labels.withColumn("column", F.lit("nowhere")))
