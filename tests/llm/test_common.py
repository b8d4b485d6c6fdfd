from dqspark.llm.common import BITS, likely_in
from pyspark.sql import functions as F


def test_likely_in_loses_no_member(spark):
    rows = spark.range(-5000, 5000).select(F.xxhash64("id").alias("h"), "id", F.lit("x").alias("_note"))
    members = rows.filter("id % 10 = 0").select(F.col("h").alias("m"))
    got = likely_in(rows, F.col("h"), members, "m")
    assert got.columns == rows.columns
    assert got.filter("id % 10 = 0").count() == 1000
    assert got.count() < 1000 + 10_000 * 1000 / BITS * 10 + 20
    edge = spark.createDataFrame([(0,), (BITS - 1,), (BITS,), (-1,)], "h long")
    assert likely_in(edge, F.col("h"), edge.limit(4), "h").count() == 4
    assert likely_in(edge, F.col("h"), edge.limit(0), "h").count() == 0
