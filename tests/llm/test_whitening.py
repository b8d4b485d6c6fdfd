"""Whitening against exact fractions, and odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from dqspark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, whitened string"


def brute(rows, k=16):
    """(n, deviations by vector, eigenvalues, vectors, means) in fractions, from the definition."""
    def ok(v):
        return v and all(c is not None and math.isfinite(c) for c in v)

    xs = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in enumerate(rows) if ok(v)}
    fit = sorted(set(xs.values()))
    n, d = len(fit), len(fit[0])
    total = [sum(x[i] for x in fit) for i in range(d)]
    mean = [Fraction(t, n) for t in total]
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    deviations = {i: sum((n * a - t) ** 2 for a, t in zip(x, total, strict=True)) for i, x in xs.items()}
    return n, xs, deviations, values[::-1][:k], vectors.T[::-1][:k], mean, float(np.trace(cov))


def check(rows, got, k=16):
    n, xs, deviations, values, vectors, mean, trace = brute(rows, k)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(found) == set(xs)
    live = sum(e > whitening.RELATIVE * values[0] for e in values) if values[0] > 0 else 0
    for i, x in xs.items():
        assert sorted(found[i]) == list(range(1, len(values) + 1))
        centred = np.array([float(a - m) for a, m in zip(x, mean, strict=True)])
        for c, r in found[i].items():
            assert r["n"] == n and r["deviation"] == deviations[i]
            if c > live:
                assert r["whitened"] is None
            else:
                assert abs(r["whitened"]) == pytest.approx(abs(centred @ vectors[c - 1]) / math.sqrt(values[c - 1]), rel=1e-6, abs=1e-6)
                assert r["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-6)
            assert r["identity_error"] <= 1e-4


@pytest.mark.parametrize("d, n", [(3, 40), (20, 200), (5, 3), (1, 9), (4, 1)])
def test_equals_fractions(spark, d, n):
    rng = random.Random(d * 100 + n)
    rows = [[rng.gauss(0, 1 + i) + 50 * i for i in range(d)] for _ in range(n)]
    rows += [rows[0], rows[0], None, [], [1.0] * (d - 1) + [None], [1.0] * (d - 1) + [float("nan")], [float("inf")] * d]
    made = spark.createDataFrame([(i, v, 1, "a", 2, "b") for i, v in enumerate(rows)], SCHEMA)
    check(rows, whitening.whiten(made).collect())


def test_same_sign_for_all_rows_and_null_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [3.0, -2.0]), (1, [1.0, 2.0]), (2, [-5.0, 0.5])]
    out = whitening.whiten(spark.createDataFrame([(*r, 1, "a", 2, "b") for r in rows], SCHEMA)).collect()
    assert len(out) == 8 and {r["n"] for r in out} == {3}
    means = [sum({r["deviation"]: r["whitened"] for r in out if r["component"] == c}.values()) for c in (1, 2)]
    assert means == pytest.approx([0, 0], abs=1e-9)


def test_far_entries_stay_exact(spark):
    rows = [[float(2**54), 1.0], [-float(2**54), 2.0], [0.0, 3.0], [1e300, 0.0], [5.0, -1.0]]
    made = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in whitening.whiten(made).filter("component = 1").collect()}
    assert set(out) == {0, 1, 2, 4}
    assert out[0]["deviation"] is None and out[0]["identity_error"] < 1e-4


def test_other_lengths_and_empty_tables(spark):
    made = spark.createDataFrame([(i, [float(i), 1.0 * i * i]) for i in range(5)] + [(9, [1.0]), (10, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"] for r in whitening.whiten(made).collect()} == set(range(5))
    for none in (made.limit(0), made.withColumn("embedding", F.lit(None).cast("array<float>"))):
        out = whitening.whiten(none)
        assert out.count() == 0 and out.columns == whitening.whiten(made).columns


def test_query_covers_the_table(spark):
    rows = [r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    ids = [r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    assert ids == list(range(len(ids)))
    check(rows, queries.op11_whitening(spark, SF).collect())
