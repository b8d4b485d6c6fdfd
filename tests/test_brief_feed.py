"""Records without their long texts: the same rows as the whole feed gives."""

import re

from dqspark.plans import catalog_fill, companies
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def folder(spark, tmp_path):
    """Small tables whose texts differ in blanks only, are blank, empty, null, not composed, or missing."""
    texts = ["Same text", " Same \t text", "", " \n ", None, "é x", "é x", "long " * 100, "long " * 100 + "!"]
    documents = [(k, texts[k % len(texts)]) for k in range(0, 300, 2)]
    spark.createDataFrame(documents, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    customers = [(k, f"Name {k}", k % 25) for k in range(300)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("nation", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_brief_rows_are_the_cleaned_ones(spark, tmp_path):
    path = folder(spark, tmp_path)
    names = ("_seq", "company_id", "state", "city")
    whole = companies.cleaned(spark, path).select(*names, F.sha2("description", 256).alias("description"))
    key = lambda r: tuple(str(v) for v in r)
    want, got = (sorted(map(tuple, d.collect()), key=key) for d in (whole, companies.brief(spark, path, *names, "description")))
    assert got == want and len(got) > 200
    digests = {r[-1] for r in got}
    assert None in digests and len(digests) == 5  # one of them null
    assert sorted(map(tuple, companies.brief(spark, path, *names).collect()), key=key) == sorted((r[:-1] for r in want), key=key)


def test_no_text_is_shuffled_for_fills(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog_fill, "pin", lambda df, name: seen.append(df) or df)
    path = folder(spark, tmp_path)
    catalog_fill._seq_records(spark, path, "company_size", "state")
    catalog_fill._records(spark, path)
    for df in seen:
        lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        text = re.search(r"Relation \[doc_id#\d+L,(text#\d+)", "\n".join(lines)).group(1)
        met = [f"sha2(cast({text} as binary), 256)" in line for line in lines]
        assert any(met) and not any(re.search(rf"{text}\b", line) for line in lines[: met.index(True)])
    assert len(seen) == 2
