from dqspark.streaming.ingest import start_ingest


def test_stream_feeds_the_same_tables(spark, company, tmp_path):
    source = str(tmp_path / "in")
    paths = [str(tmp_path / p) for p in ("clean", "bad", "state")]
    for step, rows in enumerate(([{}, {"company_id": "2", "url": "x"}], [{}, {"company_id": "3"}, {"company_id": None}])):
        company(*rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(company({}).schema).parquet(source)
        query = start_ingest(stream, *paths)
        query.awaitTermination(100)
        assert query.exception() is None
    assert sorted(r["company_id"] for r in spark.read.parquet(paths[0]).collect()) == [1, 3]
    bad = spark.read.parquet(paths[1])
    assert bad.count() == 2 and bad.select("id").distinct().count() == 2
