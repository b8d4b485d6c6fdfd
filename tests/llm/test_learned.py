"""The two classifiers: held-out accuracy, defined scores, small and odd tables."""

import pytest
from conftest import SF

from dqspark.llm import labels, quality, queries, toxicity
from dqspark.llm.common import table
from pyspark.sql import functions as F

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, label, right", [(queries.op2_quality, "quality", 0.95), (queries.op7_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, right):
    out = query(spark, BIG)
    judged = out.join(table(spark, BIG, "labels"), "doc_id")
    row = judged.filter("held_out").agg(
        F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("ok"), F.count("*").alias("n")).first()
    assert row["n"] > 50 and row["ok"] >= right
    assert out.filter("score < 0 or score > 1 or isnan(score) or score is null").isEmpty()
    assert out.count() == 1000


@pytest.mark.parametrize("query", [queries.op2_quality, queries.op7_toxicity])
def test_odd_rows(spark, documents, folder, query):
    rows = [(i, f"plain words number {i} and some more") for i in range(30)]
    rows += [(i, "### *** ### idiot ***") for i in range(30, 60)]
    rows += [(60, None), (61, ""), (None, "text"), (1, rows[1][1]), (62, "z" * 400_000)]
    seen = spark.createDataFrame(
        [(i, int(i < 30), int(i >= 30)) for i in range(60)] + [(5, None, None), (None, 1, 1), (7, 1, 0)],
        "doc_id long, quality int, toxic int")
    out = query(spark, folder(documents=documents(rows), labels=seen)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (60, 61)}) == 1
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1


@pytest.mark.parametrize("query", [queries.op2_quality, queries.op7_toxicity])
@pytest.mark.parametrize("seen", [[], [(1, 1, 1), (2, 1, 1)]])
def test_no_or_one_class(spark, documents, folder, query, seen):
    made = spark.createDataFrame(seen, "doc_id long, quality int, toxic int")
    out = query(spark, folder(documents=documents([(1, "a b"), (2, None)]), labels=made)).collect()
    assert len(out) == 2 and all((r["score"] > 0.5) == bool(seen) for r in out)
    assert query(spark, folder(documents=documents([]), labels=made)).count() == 0


def test_sample_is_bounded_and_weighted(spark):
    made = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "doc_id long, toxic int")
    out = labels.sample(made, "toxic", F.lit(True), bound=40)
    got = {r["label"]: (r["n"], r["w"]) for r in out.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert got[0] == (40, pytest.approx(450)) and got[1] == (40, pytest.approx(50))


def test_labels_are_learned_outside_the_fold_only(spark):
    docs, made = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = made.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(labels.labelled_texts(docs, m, "quality", 5, 0)) for m in (made, flipped))
    assert a == b


def test_prefix_terms_join_inflected_forms():
    slots = toxicity.Slots()
    assert set(slots.of_text("loweist")) & set(slots.of_text("LOWEIung!"))
    assert slots.of_text(None).tolist() == []


def test_pair_of_neutral_words(spark):
    """Only the two words together are toxic; alone each is as frequent in either class, behind thousands of other terms."""
    import random

    from conftest_llm import prose

    rng, filler = random.Random(4), prose(11, 1500)
    kinds = [("grelb sontu", 1), ("vapple", 1), ("grelb", 0), ("sontu", 0)]
    made = [(" ".join([*rng.sample(filler, 12), words]), label, 1.0) for _ in range(250) for words, label in kinds]
    model = toxicity.fit(spark.createDataFrame(made, "text string, label int, weight double"))
    asked = [(k, " ".join([*rng.sample(filler, 12), kinds[k][0]])) for _ in range(50) for k in range(4)]
    out = model.apply(spark.createDataFrame(asked, "doc_id int, text string"))
    right = out.select(((F.col("score") >= toxicity.THRESHOLD) == (F.col("doc_id") < 2)).cast("int").alias("ok"), "doc_id")
    assert all(r["ok"] >= 0.9 for r in right.groupBy("doc_id").agg(F.avg("ok").alias("ok")).collect())
