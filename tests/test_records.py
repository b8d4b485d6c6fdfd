"""CSV records over line breaks in several tasks, JSON arrays, and how blocks hand on their state."""

import csv
import io
import random

import pytest
from dqspark.sources import files, records


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes, so that short files have many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def plain(text):
    """Rows of the standard reader, empty cells null."""
    return [tuple(c or None for c in r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r]


def test_the_tried_case(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,note\n1,a,"line one\nline two"\n2,b,plain\n')
    assert rows_of(files.load_file(spark, str(tmp_path / "a.csv"))) == [("1", "a", "line one\nline two"), ("2", "b", "plain")]


def test_many_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(9)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "text", "note"])
    for i in range(400):
        kind = rng.randrange(7)
        text = ["plain", 'say ""', "two\nlines", "a,b", "\n" * rng.randint(1, 4), 'q"\n"x', "long " * rng.randint(1, 300)][kind]
        if kind == 6 and i % 5 == 0:
            text = "\n".join(["inside"] * 200)  # whole blocks without a quote, inside a field
        w.writerow([i, text, rng.choice(["", "x", '5" pipe'])])
    (tmp_path / "b.csv").write_text(out.getvalue(), newline="")
    df = files.load_file(spark, str(tmp_path / "b.csv"))
    assert records.lines_of(spark, str(tmp_path / "b.csv")).rdd.getNumPartitions() > 20
    assert rows_of(df) == plain(out.getvalue())


def test_several_files_and_line_ends(spark, tmp_path, small_blocks):
    (tmp_path / "d.csv").mkdir()
    (tmp_path / "d.csv" / "1.csv").write_bytes('a,a,\r\n1,"x\r\ny",2\r\n\r\n3,,""\r\n'.encode())
    (tmp_path / "d.csv" / "2.csv").write_text("a,a,\n4,5,6\n")
    df = files.load_file(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["a0", "a1", "_c2"]
    assert rows_of(df) == [("1", "x\r\ny", "2"), ("3", None, None), ("4", "5", "6")]


def test_quote_inside_an_unquoted_field_opens_nothing(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b\n1,5" nail\n2,"x\ny"\n3,6" nail\n')
    assert rows_of(files.load_file(spark, str(tmp_path / "c.csv"))) == [("1", '5" nail'), ("2", "x\ny"), ("3", '6" nail')]


def test_files_without_line_breaks_use_the_plain_reader(spark, tmp_path):
    (tmp_path / "e.csv").write_text('a,b\n1,"x, y"\n')
    df = files.load_file(spark, str(tmp_path / "e.csv"))
    assert "from_csv" not in df._jdf.queryExecution().toString() and rows_of(df) == [("1", "x, y")]


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('"a","b"', False, False), ('b",c', False, False), ('b","c', True, True),
    ('a""', False, True), ('"a""', True, False), ("", False, True), ('x"y', False, False), ('x","y', True, True),
])
def test_state_behind_a_line(line, outside, inside):
    assert (records.stays_open(line, False), records.stays_open(line, True)) == (outside, inside)


def test_state_is_handed_on_across_blocks(spark):
    rng = random.Random(3)
    rows, want = [], []
    for f in range(6):
        now = False
        for b in range(0, 200, 10):
            if rng.random() < 0.3:
                continue
            out, in_ = rng.choice([(True, False), (False, True), (True, True), (False, False)])
            before, now = now, in_ if now else out
            rows.append((f"f{f}", b, out, in_, True))
            if now != before:
                want.append((f"f{f}", b, now))
    df = spark.createDataFrame(rows, "file string, block bigint, from_outside boolean, from_inside boolean, crossed boolean")
    assert sorted(rows_of(records.changes(df))) == sorted(want)


def test_json_arrays_and_lines(spark, tmp_path):
    for name, text in (("l", '{"a": 1}\n{"a": 2}\n'), ("r", '[{"a": 1}, {"a": 2}]'), ("p", '[\n  {\n "a": 1\n },\n {"a": 2}\n]\n')):
        (tmp_path / f"{name}.json").write_text(text)
        df = files.load_file(spark, str(tmp_path / f"{name}.json"))
        assert df.columns == ["a"] and sorted(rows_of(df)) == [(1,), (2,)]
    (tmp_path / "k.json").write_text('{"a": 1}\n')
    assert files.load_file(spark, str(tmp_path / "k.json"), n_rows=1).count() == 1
