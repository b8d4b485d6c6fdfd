import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dqspark.functions import text as tx
from dqspark.operators import fingerprint, infer
from dqspark.operators.contract import annotate


def prints(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return fingerprint.fingerprint(df).first().asDict()


def test_fingerprint_against_direct_counts(spark):
    values = ["Ab 12", "Ab 12", None, "", " x² 3.5 ", "　é Z", "1_000", "nan", "long " * 40 + "end٣", "a@b.co", "www.x.io", "2024-01-01", "1/2/24"]
    got = prints(spark, values)
    known = [v for v in values if v]
    chars = [c for v in known for c in v]
    tokens = [len(t) for v in known for t in v.split()]
    pairs = [(a, b) for v in known for a, b in zip(v, v[1:])]

    def floats(v):
        try:
            float(v)
            return True
        except ValueError:
            return False

    alpha, digit, space = (sum(f(c) for c in chars) for f in (str.isalpha, str.isdigit, str.isspace))
    n = len(known)
    want = {
        "null_ratio": 1 - n / len(values), "cardinality_ratio": len(set(known)) / n, "distinct_count_log": math.log1p(len(set(known))),
        "frac_alpha": alpha / len(chars), "frac_digit": digit / len(chars), "frac_space": space / len(chars),
        "frac_punct": (len(chars) - alpha - digit - space) / len(chars),
        "frac_upper_of_alpha": sum(c.isupper() for c in chars) / alpha,
        "avg_value_length": statistics.fmean(map(len, known)), "std_value_length": statistics.pstdev(map(len, known)),
        "avg_token_length": statistics.fmean(tokens), "std_token_length": statistics.pstdev(tokens), "avg_num_tokens": len(tokens) / n,
        "email_hit_rate": 1 / n, "url_hit_rate": 1 / n, "date_hit_rate": 2 / n, "numeric_regex_hit_rate": 0.0,
        "numeric_parse_rate": sum(map(floats, known)) / n,
        "digit_bigram_rate": sum(a.isdigit() and b.isdigit() for a, b in pairs) / len(pairs),
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-9), name


def test_fingerprint_of_an_empty_column(spark):
    got = prints(spark, [None, "", None])
    assert got["null_ratio"] == 1.0 and all(got[f] == 0.0 for f in fingerprint.FEATURES if f != "null_ratio")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("1_.eE+-nifa \t\n ²٣")), max_size=6), min_size=60, max_size=90))
def test_float_grammar_is_pythons(spark, values):
    def parses(v):
        try:
            float(v)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.col("v").rlike(tx.FLOAT).alias("hit")).collect()
    assert [r["hit"] for r in rows] == [parses(r["v"]) for r in rows]


def test_sample_values_keep_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "", None, "a", "b", "c", "d", "e", "f"])], "_seq bigint, c string")
    got = [r["value"] for r in fingerprint.sample_values(df, "_seq").orderBy("position").collect()]
    assert got == ["b", "a", "c", "d", "e"]


def spec(spark, kind, values, confidence=0.9):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    p = infer.profile(df)
    predicted = spark.createDataFrame([("c", kind, confidence)], "column string, predicted_type string, confidence double")
    return infer.field_specs(p, infer.observed_values(df, p), predicted).first()


@pytest.mark.parametrize("kind,values,python_type,flag", [
    ("identifier", ["1", "2"], "int", None),
    ("identifier", ["A-1", "2"], "str", None),
    ("identifier", ["1", None], "int", "observed null"),
    ("categorical", ["a", "b"], "str", None),
    ("categorical", ["1", "2", "3"], "str", "ordinal"),
    ("categorical", ["True", "false"], "str", "possible boolean"),
    ("free_text", ["x y"], "str", None),
    ("date", ["2020-01-01", "2021-06-15"], "date", None),
    ("date", ["01/15/2020"], "str", "MM/DD/YYYY"),
    ("date", ["soon"], "str", "treat this prediction with suspicion"),
    ("boolean", ["0", "1"], "bool", "0/1-coded"),
    ("boolean", ["2", "5"], "str", "NOT all Pydantic-bool-parseable"),
    ("boolean", ["1", "2", "3"], "str", "definitional contradiction"),
    ("boolean", [None, " "], "bool", "0/1-coded"),
    ("numeric_continuous", ["1.5", "200"], "float", None),
])
def test_field_specs(spark, kind, values, python_type, flag):
    row = spec(spark, kind, values)
    assert row["python_type"] == python_type and row["required"] == (kind == "identifier")
    assert (any(flag in f for f in row["risk_flags"])) if flag else row["risk_flags"] == []


def test_spec_comments_and_low_confidence(spark):
    assert "Observed values (2): ['a', 'b']" in spec(spark, "categorical", ["b", "a", "a"])["comments"]
    assert "too many to list" in spec(spark, "categorical", [f"v{i}" for i in range(50)])["comments"][0]
    assert spec(spark, "numeric_continuous", ["100.5", "200", "x"])["comments"] == ["Observed range: [100.5, 200] (not enforced)"]
    assert any("low-confidence" in f for f in spec(spark, "free_text", ["a"], 0.3)["risk_flags"])
    with pytest.raises(Exception, match="unknown predicted type"):
        spec(spark, "nonsense", ["a"])


def test_names_are_made_usable(spark):
    got = infer.sanitize(spark, ["company size!", "a-b", "a.b", "class", "1x", "", "größe m²", "a b", "a_b_3"])
    assert list(got.values()) == ["company_size_", "a_b", "a_b_2", "class_", "col_1x", "col_", "größe_m_", "a_b_4", "a_b_3"]
    assert infer.sanitize(spark, []) == {}


def test_inferred_contract_applies_to_its_rows(spark):
    df = spark.createDataFrame([("1", "www.x.io", "a"), ("2", "HTTPS://x.io/", None)], "`the id` string, home string, note string")
    predicted = spark.createDataFrame(
        [("the id", "identifier", 0.9), ("home", "url", 0.9), ("note", "free_text", 0.9)],
        "column string, predicted_type string, confidence double",
    )
    rules, _ = infer.infer_contract(df, predicted)
    assert [(f.name, f.alias) for f in rules.fields] == [("the_id", "the id"), ("home", None), ("note", None)]
    rows = annotate(df, rules).collect()
    # the pattern keeps its letters' case, the share in the fingerprint does not
    assert [len(r["reasons"]) for r in rows] == [0, 1] and rows[0]["record"]["the_id"] == 1


def test_labels_without_a_fingerprint_are_an_error(spark):
    one = fingerprint.fingerprint_tables({"t": spark.createDataFrame([("x",)], "c string")})
    labels = spark.createDataFrame([("t", "c", "free_text"), ("t", "gone", "url")], "source string, column string, label string")
    with pytest.raises(KeyError, match="t.gone"):
        fingerprint.label_fingerprints(one, labels)
