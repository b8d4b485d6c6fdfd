import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from dqspark.operators import augment, clean, contract, iforest, metrics, ranking, rowfeat, zip3
from dqspark.sources import files, sinks

DEMO = '''company_id,name,description,company_size,state,country,city,zip_code,address,url
10,Acme   Corp,"A maker, of ""things"".",3,NY,US,New York,10001,1 Main St,https://www.example.com/acme
10,Acme   Corp,"A maker, of ""things"".",3,NY,US,New York,10001,1 Main St,https://www.example.com/acme
11,Globex,Sprockets.,99,CA,0,Los Angeles,90001,4 Oak Ave,https://www.example.com/globex
,Initech,No id.,2,0,US,Austin,73301,7 Pine Rd,https://www.example.com/initech
12,Umbrella,Bad url.,4,TX,US,Houston,77001,3 Elm St,not-a-valid-url
'''


def test_readers(spark, tmp_path):
    path = tmp_path / "demo.csv"
    path.write_text(DEMO)
    df = files.load_file(spark, str(path))
    assert set(t for _, t in df.dtypes) == {"string"} and df.count() == 5
    assert df.filter("company_id IS NULL").count() == 1 and df.first()["description"] == 'A maker, of "things".'
    assert files.load_file(spark, str(path), n_rows=2).count() == 2
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": null}]')
    assert files.load_file(spark, str(tmp_path / "x.json")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.load_file(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(ValueError):
        files.load_file(spark, str(tmp_path / "x.txt"))


def test_batch_from_file_to_tables(spark, tmp_path):
    from dqspark.plans.run import run_batch

    path = tmp_path / "demo.csv"
    path.write_text(DEMO)
    clean_path, bad_path = str(tmp_path / "clean"), str(tmp_path / "bad")
    for written in (1, 0):
        report = run_batch(files.load_file(spark, str(path)), clean_path, bad_path)
        assert (report["ingested"], report["passed"], report["failed_contract"], report["duplicates_removed"]) == (5, 2, 3, 1)
        assert (report["written_clean"], report["written_quarantine"]) == (written, 3)
    bad = spark.read.parquet(bad_path)
    assert bad.count() == 6 and bad.select("id").distinct().count() == 6
    raw = json.loads(bad.filter(F.get_json_object("raw_data", "$.name") == "Initech").first()["raw_data"])
    assert raw["company_id"] is None and raw["state"] == "0"
    row = spark.read.parquet(clean_path).first()
    assert row["name"] == "Acme Corp" and dict(spark.read.parquet(clean_path).dtypes)["company_size"] == "smallint"


class NameModel:
    """Flags rows whose name is Bad."""

    version, threshold = "9", 0.5

    def score(self, df):
        return df.withColumn("score", F.when(F.col("name") == "Bad", 1.0).otherwise(0.0))


def test_a_flagged_first_row_does_not_take_its_key(spark, company, tmp_path):
    from dqspark.plans.run import run_batch

    rows = company({"name": "Bad"}, {"name": "Good"}, {"company_id": "2"}, {"company_id": "2", "name": "Later"},
                   {"company_id": "2"}, {"company_id": "x"})
    report = run_batch(rows, str(tmp_path / "c"), str(tmp_path / "q"), NameModel())
    got = {r["company_id"]: r["name"] for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {1: "Good", 2: "Acme"}
    assert (report["ml_flagged"], report["key_conflict"], report["duplicates_removed"]) == (1, 1, 1)
    assert report["ingested"] == sum(report[k] for k in ("written_clean", "written_quarantine", "duplicates_removed", "key_conflict"))


def test_lookup_is_the_same_beyond_the_limit(spark):
    from dqspark.operators.lookup import look_up

    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(40)], "id int, k int")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(4)], "k int, v string")
    small, large = (sorted(map(tuple, look_up(df, table, "k", limit=n).select("id", "k", "v").collect()), key=str) for n in (10, 0))
    assert small == large and len(small) == 40


def test_dedup_keeps_the_first_and_merges_nulls(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1), (5, "b ", 1)], "_seq bigint, x string, y int")
    got = {(r["_seq"], r["x"]) for r in clean.remove_exact_duplicates(df).collect()}
    assert got == {(1, "a"), (2, "b"), (5, "b ")}
    assert clean.duplicate_report(df).first().asDict() == {"rows": 4, "kept": 3, "removed": 1}


def test_coercion_is_not_a_cast(spark):
    df = spark.createDataFrame([("12", "1.5"), ("5d", "5d"), (" 12 ", "1e3"), ("1.0", "x")], "a string, b string")
    rows = clean.coerce_types(df, {"a": "bigint", "b": "double", "gone": "int"}).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(12, 1.5), (None, None), (None, 1000.0), (None, None)]


def test_text_normalization_is_nfkc(spark):
    texts = ["  a \t b\n", "ﬁne ①", "ｆｕｌｌ　width", "é", " ", "", None, "IBM"]
    rows = clean.normalize_text_columns(spark.createDataFrame([(t,) for t in texts], "t string"), ["t", "gone"]).collect()
    want = [" ".join(unicodedata.normalize("NFKC", t).split()) or None if t is not None else None for t in texts]
    assert [r["t"] for r in rows] == want


def test_upsert_absent(spark):
    existing = spark.createDataFrame([(1,)], "k bigint")
    new = spark.createDataFrame([(9, 1, "a"), (2, 2, "late"), (1, 2, "early"), (3, 3, None)], "_seq bigint, k bigint, v string")
    got = {(r["k"], r["v"]) for r in sinks.upsert_absent(existing, new, "k").collect()}
    assert got == {(2, "early"), (3, None)}


def test_reviews_are_final(spark, tmp_path):
    path = str(tmp_path / "reviews")
    assert sinks.submit_review(spark, path, 7, "confirmed_bad") is True
    assert sinks.submit_review(spark, path, 7, "false_positive") is False
    with pytest.raises(ValueError):
        sinks.submit_review(spark, path, 8, "maybe")
    assert [r["decision"] for r in spark.read.parquet(path).collect()] == ["confirmed_bad"]


def test_versions_change_with_the_winner(spark, tmp_path):
    path = str(tmp_path / "versions")
    steps = [sinks.register_version(spark, path, "m", w) for w in ("knn", "knn", "trees")]
    assert steps == [("1", True), ("1", False), ("2", True)]


def test_row_features(company, spark):
    reference = spark.createDataFrame([("100", "NY", 2), ("902", "CA", 2)], "zip3 string, state string, n bigint")
    df = company(
        {}, {"description": None, "city": None}, {"description": "Hello Ã© â€™ wOrld12"}, {"state": "CA"}, {"state": "ca ", "zip_code": "90210"},
        {"country": "GB"}, {"description": "Ends here. "}, {"url": "x", "company_size": "9"},
    )
    r = rowfeat.row_features(df, reference).orderBy("_seq").collect()
    assert r[0]["null_count"] == 0 and r[1]["null_count"] == 2 and r[1]["ends_without_terminal_punct"] == 0
    assert r[2]["description_mojibake_rate"] == pytest.approx(2 / 20) and r[2]["trailing_char_class_diversity"] == 3
    assert [x["zip_state_mismatch"] for x in r[:6]] == [0, 0, 0, 1, 0, -1]
    assert r[6]["ends_without_terminal_punct"] == 0 and r[2]["ends_without_terminal_punct"] == 1
    assert r[7]["contract_violation_count"] == 2 and r[0]["description_frac_punct"] == pytest.approx(1 / 8)


def test_damage_touches_only_its_rows(company):
    df = company(*[{"company_id": str(i), "description": f"He said - 'see' row {i} \"x\"."} for i in range(40)])
    keep = F.col("company_id").cast("int") % 2 == 0
    before = {r["company_id"]: r for r in df.collect()}
    for damage, field in ((augment.damage_encoding, "description"), (augment.damage_truncation, "description")):
        for r in damage(df, "company_id", where=keep).collect():
            same = r[field] == before[r["company_id"]][field]
            assert same == (int(r["company_id"]) % 2 == 1)
    nulls = augment.damage_nulls(df, "company_id", where=keep).collect()
    for r in nulls:
        n = sum(r[c] is None for c in rowfeat.OPTIONAL)
        assert (5 <= n <= 7) if int(r["company_id"]) % 2 == 0 else n == 0


def test_damaged_zip_is_of_another_state(spark, company):
    zips = {"NY": "10001", "CA": "90210", "FL": "33101"}
    df = company(*[{"company_id": str(i), "state": s, "zip_code": z} for i in range(20) for s, z in zips.items()])
    df = df.withColumn("company_id", F.col("_seq").cast("string"))
    reference = zip3.zip3_reference(df)
    out = augment.damage_zip(df, "company_id", reference, zip3.zip3_pool(df, reference)).collect()
    assert len(out) == 60 and all(r["zip_code"] in zips.values() and zips[r["state"]] != r["zip_code"] for r in out)


def test_split_and_sample(spark):
    df = spark.range(0, 1000).select("id", F.when(F.col("id") < 700, "big").when(F.col("id") < 703, "small").when(F.col("id") == 703, "one").otherwise("rest").alias("label"))
    got = {r["label"]: (r["n"], r["t"]) for r in ranking.stratified_split(df, "label", "id", 0.25).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {"big": (700, 175), "small": (3, 1), "one": (1, 0), "rest": (296, 74)}
    a = {r["id"] for r in ranking.sample_exact_n(df, "id", 100, 7).collect()}
    assert len(a) == 100 and a == {r["id"] for r in ranking.sample_exact_n(df.repartition(3), "id", 100, 7).collect()}
    assert ranking.sample_exact_n(df, "id", 5000, 7).count() == 1000


def test_running_sums(spark):
    df = spark.createDataFrame([(float(i * i % 97), i) for i in range(97)], "v double, n bigint").groupBy("v").agg(F.sum("n").alias("n"))
    rows = ranking.running_sums(df, "v", ["n"], buckets=7).orderBy("v").collect()
    total = 0
    for r in rows:
        total += r["n"]
        assert r["cum_n"] == total and r["total_n"] == sum(range(97))


def test_outliers_score_lowest(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(500)] + [(999, 500.0, -300.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    forest = iforest.fit(df, ("a", "b"), "id", trees=30)
    scored = df.select("id", iforest.anomaly_score(forest, ("a", "b"), 256).alias("s")).orderBy("s").collect()
    assert scored[0]["id"] == 999 and scored[0]["s"] < 0 < scored[-1]["s"]


def test_metrics_on_hand_counts(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "t string, p string")
    assert metrics.macro_f1(df, "t", "p").first()["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 4)
    tied = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "s double, y int")
    assert metrics.average_precision(tied, "s", "y").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
