import corpus_pipeline as cp
import pytest
from conftest_llm import prose
from dqspark.llm import quality
from pyspark.sql import functions as F
from test_neardup import brute as brute_components
from test_pii import base

import __spark_entry__ as entry


def tables(spark, documents, folder, rows):
    good = [(i, int(i < 40), 0) for i in range(60)]
    return folder(
        documents=documents(rows), labels=spark.createDataFrame(good, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, " ".join(prose(5000, 30)))], "item_id long, text string"),
    )


def corpus():
    rows = [(i, " ".join(prose(i, 60 + i)) + f" mail x{i}@y.example", ("en", "de")[i % 2], f"s{i % 3}") for i in range(40)]
    rows += [(i, "@@@ ### " * (20 + i), "en", "s1") for i in range(40, 60)]
    rows += [(100 + i, " ".join(prose(i, 60 + i)[:-1]) + f" mail x{i}@y.example", "en", "s0") for i in range(10)]  # near copies
    rows += [(200, " ".join(prose(6000, 50) + prose(5000, 30)), "en", "s2"), (201, None), (None, "some words here"), (202, "")]
    return [*rows, rows[7], rows[7]]


def test_stages(spark, documents, folder):
    path = tables(spark, documents, folder, corpus())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = cp.pin(stage(spark, docs, path), name)
        steps[name] = docs
        if name != cp.STAGES[-1][0]:
            assert docs.columns == steps["documents"].columns
    ids = {k: [r[0] for r in v.select("doc_id").collect()] for k, v in steps.items()}
    assert not set(ids["quality"]) & set(range(40, 60)) and set(range(40)) <= set(ids["quality"])
    kept = {d for d, _, _, own in brute_components([(r["doc_id"], r["text"]) for r in steps["quality"].collect() if r["doc_id"] is not None]) if own}
    assert set(ids["neardup"]) - {None} == kept and len(ids["neardup"]) == len(set(ids["neardup"]))
    assert set(ids["neardup"]) - set(ids["decontaminate"]) == {200}
    assert sorted(map(str, ids["pii"])) == sorted(map(str, ids["decontaminate"]))
    assert all(not base(r["text"] or "") for r in steps["pii"].collect())
    assert all(r["n_chars"] == len(r["text"]) for r in steps["pii"].collect() if r["text"] is not None)
    last = steps["mixing"].collect()
    assert last and all(len(r["text"].split()) == r["taken"] for r in last if r["text"])
    assert set(steps["mixing"].columns) >= {"doc_id", "text", "epoch", "taken"}


def test_run_equals_stages(spark, documents, folder):
    path = tables(spark, documents, folder, corpus())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = cp.pin(stage(spark, docs, path), "step")
    key = lambda df: sorted(map(str, df.select("doc_id", "epoch", "taken", "text").collect()))
    assert key(cp.run(spark, path)) == key(docs)


def test_budget_holds_without_ids(spark, documents):
    docs = documents([(None, "w " * 10)] * 20)
    out = cp.mix_sources(spark, docs, "").collect()
    assert sum(r["taken"] for r in out) == 120 and sum(len(r["text"].split()) for r in out) == 120
    again = documents([(None, "w " * 10)] * 20 + [(i, "w " * 10) for i in range(20)])
    assert sum(r["taken"] for r in cp.mix_sources(spark, again, "").collect()) == 240


def test_empty(spark, documents, folder):
    assert cp.run(spark, tables(spark, documents, folder, [])).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_per_operator(n):
    assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1


def test_registry():
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert quality.THRESHOLD == 0.3 and F is not None
