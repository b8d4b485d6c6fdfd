"""Two tables, one commit: absent keys, what is read to find them, broken runs, two writers."""

import pytest
from dqspark.sources import ledger
from dqspark.sources.ledger import Ledger
from pyspark.sql import functions as F

REASONS = "raw string, reasons array<struct<rule:string,message:string,severity:string,model_version:string,score:double,features:map<string,double>>>"


def rows(spark, ids, tag="a"):
    return spark.createDataFrame([(i, tag, n) for n, i in enumerate(ids)], "company_id bigint, name string, _seq bigint")


def bad(spark, n):
    return spark.createDataFrame([('{"x": 1}', [("url", "m", "error", None, None, None)])] * n, REASONS)


def test_absent_keys_only(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), buckets=16)
    assert book.clean() is None and book.latest_run() is None and book.runs().count() == 0
    first = book.write(rows(spark, [*range(100), 5, 5]), bad(spark, 3))
    assert (first["clean"], first["quarantine"], first["number"]) == (100, 3, 1)
    again = Ledger(spark, str(tmp_path / "l"))
    second = again.write(rows(spark, [*range(50, 120), 130, 130], "b"), bad(spark, 2))
    assert (again.buckets, second["clean"], second["number"]) == (16, 21, 2)
    got = {r["company_id"]: r["name"] for r in again.clean().collect()}
    assert len(got) == 121 and got[60] == "a" and got[110] == "b"
    assert sorted(r["id"] for r in again.quarantine().collect()) == sorted({r["id"] for r in again.quarantine().collect()})
    assert again.quarantine().count() == 5
    assert again.write(rows(spark, range(120), "c"), bad(spark, 0))["clean"] == 0
    assert [tuple(r) for r in again.runs().select("number", "clean", "quarantine").collect()] == [(1, 100, 3), (2, 21, 2), (3, 0, 0)]
    assert again.latest_run()["number"] == 3


def test_a_second_batch_reads_a_part_of_the_keys(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), buckets=64)
    book.write(rows(spark, range(2000)), bad(spark, 0))
    new = book.suspects(rows(spark, range(50_000, 50_400)))
    assert new.count() < 10  # hardly any new key is looked for in the clean table
    known = book.known_keys(book.suspects(rows(spark, [7, 8, 9, 60_000])))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert known.select(F.input_file_name()).distinct().count() <= 4 and known.columns == ["company_id"]
    assert {7, 8, 9} <= {r["company_id"] for r in known.collect()} and known.count() < 400
    assert book.known_keys(book.suspects(rows(spark, []))) is None


def test_crowded_bits_stay_exact(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), buckets=2, filter_bits=8)
    book.write(rows(spark, range(0, 400, 2)), bad(spark, 0))
    assert book.write(rows(spark, range(400)), bad(spark, 0))["clean"] == 200
    assert sorted(r["company_id"] for r in book.clean().collect()) == list(range(400))


def test_a_run_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    book = Ledger(spark, str(tmp_path / "l"), buckets=4)
    book.write(rows(spark, range(10)), bad(spark, 1))

    def dies(*_):
        raise OSError("lost between the two writes")

    monkeypatch.setattr(ledger, "quarantine_records", dies)
    with pytest.raises(OSError):
        book.write(rows(spark, range(20)), bad(spark, 4))
    monkeypatch.undo()
    assert (tmp_path / "l" / "clean").is_dir() and len(list((tmp_path / "l" / "clean").glob("run=*"))) == 2
    assert book.clean().count() == 10 and book.quarantine().count() == 1 and book.latest_run()["number"] == 1
    assert book.write(rows(spark, range(20)), bad(spark, 4))["clean"] == 10
    assert book.clean().count() == 20 and book.quarantine().count() == 5


def test_two_writers(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "l"), buckets=4)
    one, two = (book.stage(rows(spark, range(5), n), bad(spark, 0), n) for n in "ab")
    book.commit(one)
    with pytest.raises(RuntimeError):
        book.commit(two)
    assert {r["name"] for r in book.clean().collect()} == {"a"}


def test_text_keys_and_odd_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("ä", 2, "y"), ("", 3, "z")], "k string, _seq bigint, cell string")
    book = Ledger(spark, str(tmp_path / "l"), "k", buckets=4)
    assert book.write(df, bad(spark, 0))["clean"] == 3
    assert book.write(df, bad(spark, 0))["clean"] == 0
    assert sorted(r["k"] for r in book.clean().collect()) == ["", "a", "ä"]
