import pytest
from pyspark.sql import functions as F

from dqspark.functions.url import http_url
from dqspark.operators import contract
from dqspark.operators.contract import Contract, Field


def failures(df, rules=contract.COMPANY):
    rows = contract.annotate(df, rules).collect()
    return [[(r["rule"], r["message"]) for r in row["reasons"]] for row in rows]


def test_all_failures_are_kept_in_field_order(company):
    out = failures(company({"company_id": None, "company_size": "99", "url": "nope"}, {}))
    assert [r for r, _ in out[0]] == ["company_id", "company_size", "url"]
    assert out[1] == []


@pytest.mark.parametrize("text,value", [
    (" 1 ", 1), ("+5", 5), ("-0", 0), ("007", 7), ("1_0", 10), ("1.0", 1), ("1_0.00", 10),
    ("", None), ("1.5", None), ("1e3", None), ("0x1", None), ("1.", None), ("_1", None), ("9" * 30, None),
])
def test_integer_text(company, text, value):
    row = contract.annotate(company({"company_id": text})).first()
    assert row["record"]["company_id"] == value
    assert (len(row["reasons"]) == 0) == (value is not None)


def test_messages(company):
    out = failures(company(
        {"company_id": None}, {"company_id": "x"}, {"company_size": "0"}, {"company_size": "8"}, {"url": None}, {"company_size": None},
    ))
    assert [o[0][1] for o in out[:5]] == [
        contract.INT_TYPE, contract.INT_PARSE, contract.AT_LEAST.format(1), contract.AT_MOST.format(7),
        "URL input should be a string or URL",
    ]
    assert out[5] == []


def test_sentinel_becomes_null_and_other_values_stay_untrimmed(company):
    rows = contract.annotate(company({"state": " 0 ", "country": "0"}, {"state": " NY"})).collect()
    assert rows[0]["record"]["state"] is None and rows[0]["record"]["country"] is None
    assert rows[1]["record"]["state"] == " NY" and rows[0]["reasons"] == []


def test_absent_and_extra_columns(company):
    df = company({}).drop("url", "city").withColumn("extra", F.lit("x"))
    row = contract.annotate(df).first()
    assert [(r["rule"], r["message"]) for r in row["reasons"]] == [("url", contract.ABSENT)]
    assert "extra" not in row["record"].asDict() and row["record"]["city"] is None
    assert row["raw"]["extra"] == "x"


def test_split_is_a_partition(company):
    df = company({}, {"url": "x"}, {"company_id": None}, {})
    valid, invalid = contract.validate_rows(df)
    assert sorted(r["_seq"] for r in valid.collect()) == [0, 3]
    assert sorted(r["_seq"] for r in invalid.collect()) == [1, 2]
    assert invalid.filter("_seq = 1").first()["raw"]["url"] == "x"


def test_typed_inputs(spark):
    df = spark.createDataFrame([(1, 2.0, 5, 1)], "a bigint, b double, c int, d int")
    rules = Contract((Field("a", "int"), Field("b", "int"), Field("c"), Field("d", "float")))
    assert failures(df, rules) == [[("c", contract.STR_TYPE)]]


def test_generated_kinds(spark):
    df = spark.createDataFrame(
        [("1_0.5", "YES", "2024-02-29"), ("x", "maybe", "2024-02-30"), (" inf ", "off", "2024-01-01T00:00:00")],
        "f string, b string, d string",
    )
    rules = Contract((Field("f", "float"), Field("b", "bool"), Field("d", "date")))
    rows = contract.annotate(df, rules).collect()
    assert rows[0]["record"]["f"] == 10.5 and rows[0]["record"]["b"] is True and str(rows[0]["record"]["d"]) == "2024-02-29"
    assert len(rows[1]["reasons"]) == 3
    assert rows[2]["record"]["f"] == float("inf") and rows[2]["record"]["b"] is False and rows[2]["reasons"] == []


URLS = [
    "http://Example.COM", "https://a.com:443/x", "http://a.com:80", "http://a.com:0080/x", "http:a.com", "http:///x",
    "http:\\\\a.com\\b", "http://a.com/../b/./c", "http://u:p@A.com/", "http://a.com/a b?q=x y#f g",
    "http://bücher.de/ü?ü#ü", "https://a.com:99999", "https://a.com:abc", "http://", "", "ftp://a.com", "not-a-url",
    "  http://a.com ", "http://[::1]/", "http://a b.com/", "http://a_b.com", "http://a..com", "http://a.com/^{}|`'\"<>",
    "http://a.com?x='y'", "http://a.com#", "http://a.com?", "http://a.com/%2e%2e/x", "http://a.com/a/..", "HTTP://A.com",
    "http://a.com/x\ty", "x:y", "http://@a.com", "http://a.com:", "http://%zz.com", "http://a.com/%zz",
    "http://a.com/a;b=c,d:@!$&()*+~", "//a.com", "http://a<b.com", "http://.com", "http://-a.com",
    "https://www.example.com/c/1", "http://ththre.example.com/fr/825?page=2&ref=x", "https://m.example.net/en/25#top",
    "http://a.com/" + "x" * 2100,
]


def test_urls_match_the_public_validator(spark):
    pydantic = pytest.importorskip("pydantic")
    adapter = pydantic.TypeAdapter(pydantic.HttpUrl)
    value, error = http_url(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", value.alias("v"), error.alias("e")).collect()
    for row in rows:
        try:
            want = (str(adapter.validate_python(row["u"])), None)
        except pydantic.ValidationError as exc:
            want = (None, exc.errors()[0]["msg"])
        assert (row["v"], row["e"]) == want, row["u"]
