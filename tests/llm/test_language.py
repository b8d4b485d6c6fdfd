"""Language of texts and spans: path against all labellings, scripts, held-out accuracy, odd rows."""

import itertools
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from dqspark.llm import language, queries
from dqspark.llm.common import table

BIG = "/root/testdata/sf0.01"


def test_path_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(0, 6, 4).tolist()
        scores = -rng.random((sum(sizes), 3)) * 4
        got, at = language.path(scores, sizes, 1.5), 0
        for n in sizes:
            own = scores[at : at + n]
            value = lambda way: sum(own[i, k] for i, k in enumerate(way)) - 1.5 * sum(a != b for a, b in itertools.pairwise(way))
            best = max((value(w) for w in itertools.product(range(3), repeat=n)), default=0)
            assert value(got[at : at + n].tolist()) == pytest.approx(best)
            at += n


def test_groups_of_letters_depend_on_the_word_only():
    together, slot = language.grams(["ab", "Ж", "ab", "abcdefgh"])
    for i, w in enumerate(["ab", "Ж", "ab", "abcdefgh"]):
        alone = language.grams([w])[1]
        assert sorted(slot[together == i]) == sorted(alone)
        n = len(w)
        assert len(alone) == n + (n + 1) + n + max(0, n - 1) + 1


def test_scripts():
    names = [language.NAMES[i] for i in language.scripts(["abc", "ß", "жук", "λ", "中文", "かな", "한글", "אב", "عرب", "ไทย", "हिन्दी", "ⴰ"])]
    assert names == ["Latin", "Latin", "Cyrillic", "Greek", "Han", "Kana", "Hangul", "Hebrew", "Arabic", "Thai", "Devanagari", ""]
    assert language._LETTERS.findall("हिन्दी ½ x² a_b 12") == ["हिन्दी", "x", "a", "b"]


ROWS = [
    ("en", "the cat and the dog were walking through the house with their friends"),
    ("en", "this is what they thought about the weather and nothing else"),
    ("de", "der hund und die katze gehen durch das haus mit ihren freunden"),
    ("de", "das ist was sie über das wetter dachten und nichts anderes"),
    ("ru", "кошка и собака шли через дом вместе со своими друзьями"),
    ("uk", "кішка і собака йшли через дім разом зі своїми друзями їжак"),
    (None, "αβγ not learned"),
]


def model(spark):
    rows = [(i, t, g) for i, (g, t) in enumerate(ROWS)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_spans_of_mixed_texts(spark):
    fitted = model(spark)
    assert fitted.names == ["de", "en", "ru", "uk"]
    en, de, ru = "the dog and the cat were walking with friends", "der hund und die katze gehen durch das haus", "кошка и собака шли вместе"
    text = f"{en}. {de}! {ru}"
    made = spark.createDataFrame([(1, text, "x"), (2, ru, "y"), (3, "½ 12 !", "z")], "doc_id long, text string, language string")
    out = {r["doc_id"]: r["language"] for r in fitted.apply(made).collect()}
    assert [(text[s["start"] : s["end"]], s["lang"]) for s in out[1]["spans"]] == [(en, "en"), (de, "de"), (ru, "ru")]
    assert out[1]["lang"] == "en" and 0 < out[1]["score"] < 1
    assert out[2]["lang"] == "ru" and out[2]["score"] == 1
    assert out[3]["lang"] == "und" and out[3]["score"] == 0 and out[3]["spans"] == []


def test_unknown_script_and_switch(spark):
    fitted = model(spark)
    got = list(fitted.label(["中文中文", "the cat αβγδεζη and dog", "the cat und the dog"], True))
    assert got[0][0] in fitted.names and got[0][1] == 0 and got[0][2] == []
    assert got[1][0] == "en" and got[1][1] == 1
    assert got[2] == ("en", 1.0, [(0, 19, "en")])  # one word does not pay for two changes


def test_batches_do_not_matter(spark, monkeypatch):
    fitted = model(spark)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(ROWS)[1] for _ in range(rng.randint(0, 4))) for _ in range(60)] + [None, "the " * 5000]
    whole = list(fitted.label(texts, False))
    monkeypatch.setattr(language, "BATCH_WORDS", 20)
    monkeypatch.setattr(language, "_CACHED", 5)
    assert list(fitted.label(texts, False)) == whole
    assert [r[:2] for r in fitted.label(texts, True)] == [r[:2] for r in whole]


def test_held_out_accuracy(spark):
    out = queries.op13_language(spark, BIG)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = table(spark, BIG, "documents").filter(F.col("text").rlike("[A-Za-z]")).select("doc_id", "lang")
    row = out.join(docs, "doc_id").filter("held_out and lang is not null").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"), F.count("*").alias("n")).first()
    assert row["n"] > 150 and row["ok"] >= 0.97
    assert out.count() == 1000 and out.filter("score < 0 or score > 1 or score is null or lang_pred is null").isEmpty()


def test_held_out_rows_are_not_learned(spark):
    docs = table(spark, SF, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    turned = docs.withColumn("lang", F.when(fold == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language.fit(d, fold != 2) for d in (docs, turned))
    assert a.names == b.names and (a.table == b.table).all()


def test_sample_is_bounded(spark):
    made = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3900, "a").otherwise("b").alias("lang"))
    got = {r["lang"]: r["count"] for r in language.learned_rows(made, F.lit(True), "doc_id", "lang", 500).groupBy("lang").count().collect()}
    assert got["b"] == 100 and 400 < got["a"] < 600


def test_odd_rows(spark, documents, folder):
    rows = [(i, t, g) for i, (g, t) in enumerate(ROWS)] * 5
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 ½ _ !", "de"), (None, "der hund", None), (None, None, None), (103, "a" * 300_000, "en")]
    rows += [(104, "the cat " * 50_000, "de")]
    made = documents([(*r, "s") for r in rows])
    out = queries.op13_language(spark, folder(documents=made)).collect()
    assert len(out) == len(rows)
    seen = {r["doc_id"]: r for r in out}
    assert all(seen[i]["lang_pred"] == "und" and seen[i]["score"] == 0 for i in (100, 101, 102))
    assert all(0 <= r["score"] <= 1 for r in out)
    bare = queries.op13_language(spark, folder(documents=made.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(bare) == len(rows) and {r["lang_pred"] for r in bare} == {"und"}
    assert queries.op13_language(spark, folder(documents=made.limit(0))).count() == 0
