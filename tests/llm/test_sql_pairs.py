"""Operators that SQL can state, on tables with odd rows."""

import pytest
from conftest_llm import prose, same_as_sql

from dqspark.llm import decontaminate, licenses, linerules, mixing, queries


def odd():
    """Null, empty, blank, repeated and very long rows."""
    long = " ".join(prose(1, 30_000))
    return [
        (9001, None), (None, "some words here"), (9002, ""), (9003, " \t\n\r\x0b\x0c "), (9004, long), (9005, "same row twice"),
        (9005, "same row twice"), (9006, "a b\n\na b\na\x0bb\na b c a b c", None, "src1"), (9007, "é ü # % $ <x>\n" * 3, "fr", None),
        (9008, "w " * 70), (9009, " x y z"),
    ]


def test_line_rules(spark, documents, folder):
    common = "Letter 2024 " + " ".join(prose(8, 58))
    rows = [(100 + i, common + "\n" + " ".join(prose(10 + i, 60 + i)), "en", "h1") for i in range(30)]
    rows += [(200 + i, f" LETTER  198{i}" + common[11:] + " \n" + " ".join(prose(50 + i, 20)), "en", "h1") for i in range(5)]
    rows += [(300 + i, common + "\n" + " ".join(prose(70 + i, 30)), "en", "h2") for i in range(5)]  # another host: too few texts
    rows += [(400 + i, " ".join(prose(99, 200)), "en", "h3") for i in range(40)]  # copies of one text make no common line
    df = documents(rows + odd())
    path = folder(documents=df)
    out = {r["doc_id"]: r for r in same_as_sql(queries.op6_linerules(spark, path), linerules.ORACLE, path, ("documents",))}
    assert not any(out[200 + i]["kept"] for i in range(5)) and not out[200]["base_failed"]
    assert all(out[k]["kept"] for k in (100, 129, 300, 400, 439))
    assert out[9008]["n_repeat_words"] == 70 and out[9008]["base_failed"]


def test_line_rules_empty(documents):
    assert linerules.judge(documents([])).count() == 0 and linerules.clean_texts(documents([])).count() == 0


@pytest.mark.parametrize("limit", [0, 20_000])
def test_common_lines_leave_the_texts(documents, monkeypatch, limit):
    from dqspark.operators import lookup

    monkeypatch.setattr(linerules, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
    own = [" ".join(prose(i, 40)) for i in range(15)]
    rows = [(i, f"Menu  one\n{t}\n\n menu ONE \nfooter 20{i:02}", "en", "h") for i, t in enumerate(own)]
    rows += [(50, "menu one", "en", "h"), (51, None, "en", "h"), (52, "", "en", "h"), (53, "Menu one\nelse", "en", None), (0, rows[0][1], "en", "h")]
    out = sorted(((r["doc_id"], r["text"]) for r in linerules.clean_texts(documents(rows), min_texts=3, share=0.5).collect()), key=str)
    want = [(i, f"{t}\n") for i, t in enumerate(own)] + [(0, f"{own[0]}\n"), (50, ""), (51, None), (52, ""), (53, "Menu one\nelse")]
    assert out == sorted(want, key=str)
    judged = {r["doc_id"]: r for r in linerules.judge(documents(rows), min_texts=3, share=0.5).collect()}
    assert judged[3]["n_removed_words"] == 6 and judged[53]["n_removed_words"] == 0 and judged[50]["n_removed_words"] == 2


@pytest.mark.parametrize("limit", [0, 50_000])
def test_copies_lose_their_words_once(spark, documents, folder, monkeypatch, limit):
    from dqspark.operators import lookup

    monkeypatch.setattr(linerules, "look_up", lambda df, table, on, how="left", _=0: lookup.look_up(df, table, on, how, limit))
    rows = [(i, f"Menu  one\n{' '.join(prose(i, 60))}\nmenu ONE", "en", "h") for i in range(25)]
    rows += [(100 + i, rows[i % 2][1], "en", "h") for i in range(6)] + [(200, "menu one", "en", "h"), (201, "menu one", "en", "h")]
    path = folder(documents=documents(rows + odd()))
    out = {r["doc_id"]: r for r in same_as_sql(queries.op6_linerules(spark, path), linerules.ORACLE, path, ("documents",))}
    assert {out[k]["n_removed_words"] for k in (0, 1, 2, 100, 105)} == {4} and out[200]["n_removed_words"] == 2


def test_long_list_of_losses_is_not_broadcast(spark, documents, monkeypatch):
    from dqspark.operators import lookup

    monkeypatch.setattr(linerules, "look_up", lambda df, table, on, how="left", _=0: lookup.look_up(df, table, on, how, 0))
    df = documents([(i, f"menu one\n{' '.join(prose(i, 60))}", "en", "h") for i in range(25)])
    for found in (linerules.judge(df), linerules.clean_texts(df)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def bench(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, size int")


def test_decontaminate(spark, documents, folder):
    items = [(i, " ".join(prose(1000 + i, 15 + 3 * i))) for i in range(12)]
    edit = lambda t, *at: " ".join("edited" if k in at else w for k, w in enumerate(t.split()))
    rows = [(i, " ".join(prose(i, 40)) + " " + t.upper() + "\n" + " ".join(prose(90 + i, 30))) for i, t in items]
    rows += [(50 + i, " ".join(prose(i, 9)) + " " + edit(t, 0) + " tail " * 3) for i, t in items]
    rows += [(80, edit(items[11][1], 20)), (81, edit(items[11][1], 5, 20, 35)), (82, items[11][1] + " " + items[3][1])]
    rows += [(83, " ".join(items[10][1].split()[:20])), (84, " ".join(prose(7, 300))), (85, "tiny item"), (86, "a tiny item")]
    items += [(20, "tiny item"), (21, ""), (22, None), (0, items[0][1]), (23, items[0][1]), (24, "x " * 20)]
    rows += [(87, "y " * 9 + "x " * 30)]
    path = folder(documents=documents(rows + odd()), benchmark=bench(spark, items))
    out = {r["doc_id"]: r for r in same_as_sql(
        queries.op5_decontaminate(spark, path), decontaminate.ORACLE, path, ("documents", "benchmark"))}
    assert all(out[i]["contaminated"] for i in [*range(12), 80, 82, 85, 87])
    assert out[82]["item_ids"] == "3,11" and out[0]["item_ids"] == "0,23"
    assert not any(out[i]["contaminated"] for i in (81, 83, 84, 86))


def every_window(items, docs):
    """(doc_id, item_id) by the similarity of all item-sized windows, one after another."""
    from collections import Counter

    cut = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    found = set()
    for doc, text in docs:
        for item, wanted in items:
            d, b = text.split(), Counter(cut(wanted.split()))
            size = len(wanted.split())
            for at in range(max(1, len(d) - size + 1)):
                a = Counter(cut(d[at : at + size]))
                if 100 * (a & b).total() >= 75 * (a | b).total():
                    found.add((doc, item))
    return found


def test_windows_inside_longer_runs(spark, documents, folder):
    import random

    rng, tail = random.Random(11), " ".join(prose(42, 26))
    items = [(1, "x " * 14 + tail), (2, tail + " y" * 20)]
    rows = [(1, "x " * 60 + tail), (2, "x " * 60 + tail + " y" * 60), (3, tail + " y" * 90), (4, tail), (5, "x " * 90)]
    for i in range(40):  # few words, so runs start, end and repeat everywhere
        items.append((10 + i, " ".join(rng.choice("abz") * rng.randint(1, 2) for _ in range(rng.randint(6, 40)))))
        run = items[-1][1].split()
        cut = run[: rng.randint(1, len(run))] * rng.randint(1, 3) + run[rng.randint(0, 9) :] + list(rng.choice("abz") * rng.randint(0, 60))
        rows.append((10 + i, " ".join(cut)))
    path = folder(documents=documents(rows), benchmark=bench(spark, items))
    out = same_as_sql(queries.op5_decontaminate(spark, path), decontaminate.ORACLE, path, ("documents", "benchmark"))
    got = {(r["doc_id"], int(i)) for r in out for i in r["item_ids"].split(",") if i}
    assert got == every_window(items, rows) and {(1, 1), (2, 1), (2, 2), (3, 2)} <= got


def test_decontaminate_without_broadcasts(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = bench(spark, [(i, " ".join(prose(1000 + i, 30))) for i in range(5)])
    docs = documents([(i, " ".join(prose(i, 20)) + " " + " ".join(prose(1000 + i, 30))) for i in range(8)])
    out = {r["doc_id"]: r["item_ids"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert out == {i: str(i) if i < 5 else "" for i in range(8)}


@pytest.mark.parametrize("no_docs", [True, False])
def test_decontaminate_empty(spark, documents, no_docs):
    docs = documents([] if no_docs else [(1, "a b c d e f")])
    out = decontaminate.decontaminate(docs, bench(spark, [(1, "a b c d e f")] if no_docs else [])).collect()
    assert [r["contaminated"] for r in out] == ([] if no_docs else [False])


def test_blocks_find_all_fingerprints_in_the_radius(spark):
    import random

    rng = random.Random(4)
    pairs = []
    for d in range(decontaminate.RADIUS + 1):
        for _ in range(6):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            pairs.append(tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b)))
    from pyspark.sql import functions as F

    near = F.transform(decontaminate.errors(), lambda e: e)
    df = spark.createDataFrame(pairs, "a long, b long").select(
        F.exists(F.zip_with(decontaminate.blocks(F.col("a")), decontaminate.blocks(F.col("b")), lambda x, y: x["value"].bitwiseXOR(y["value"])),
                 lambda v: F.array_contains(near, v)).alias("met"))
    assert df.filter("not met").isEmpty()


def test_simhash_is_a_majority_of_bits(spark):
    df = spark.sql("SELECT array(1L, 3L, -1L) AS s, array(CAST(NULL AS BIGINT)) AS n, array(-1L) AS m")
    row = df.select(decontaminate.simhash(df.s).alias("s"), decontaminate.simhash(df.m).alias("m")).first()
    assert (row["s"], row["m"]) == (3, -1)


def test_mixing(spark, documents, folder):
    rows = [(i, " ".join(prose(i, 5 + i % 40)), ("en", "de", "fr", None)[i % 4], ("web1", "web2", "book", None, "web1")[i % 5]) for i in range(400)]
    rows += [(900, "tiny", "xx", "web9"), (901, "one two", "yy", "solo")]
    path = folder(documents=documents(rows + odd()))
    out = same_as_sql(queries.op8_mixing(spark, path), mixing.ORACLE, path, ("documents",))
    assert any(r["taken"] < r["tokens"] for r in out) and max(r["epoch"] for r in out) >= 1


def test_shortages_go_to_siblings_first(spark, documents):
    sized = lambda k, n, lang, source: [(k * 1000 + i, "w " * 10, lang, source) for i in range(n)]
    rows = documents(sized(1, 100, "a", "x1") + sized(2, 1, "a", "x2") + sized(3, 100, "b", "y1"))
    weights = {("x",): 1, ("y",): 1, ("x", "a"): 1, ("y", "b"): 1, ("x", "a", "x1"): 1, ("x", "a", "x2"): 1, ("y", "b", "y1"): 1}
    plan = mixing.budgets(mixing.measured(rows), share=(1, 2), max_epochs=2, targets=weights)
    got = {r["source"]: r["budget"] for r in plan.collect()}
    # half of 2010 tokens: 502 for each domain; x2 can take 20, the rest of its half stays with its sibling x1
    assert got == {"x1": 482, "x2": 20, "y1": 502}


def test_mix_meets_budgets(documents):
    rows = documents([(i, "w " * (1 + i % 17), ("en", "de")[i % 2], f"s{i % 3}") for i in range(500)])
    per = {}
    for r in mixing.mix(rows).collect():
        per[r["lang"], r["source"]] = per.get((r["lang"], r["source"]), 0) + r["taken"]
    assert per == {(r["lang"], r["source"]): r["budget"] for r in mixing.budgets(mixing.measured(rows)).collect()}
    assert mixing.mix(documents([])).count() == 0


def test_licences(spark, documents, folder):
    mit = next(t for k, t in licenses.TEMPLATES if k == "MIT" and len(t) > 300)
    rows = [
        (1, mit.replace(". ", ".\n"), "a", "r1"), (2, "plain code", "a", "r1"), (3, "x = 1\n# Licensed under the Apache License, Version 2.0.\n" + "y " * 40, "a", "r1"),
        (4, "plain", "b", "r1"), (5, "the licence of poetry is a long tale of many other words", "b", "r1"), (6, "All rights reserved.", "c", "r2"),
        (7, "Released under the MIT License.\nAll rights reserved.", "c", "r2"), (8, "anything", "c", "r2"), (9, "a" * 9 + "\n\n" + mit + "\n \nrest", "d", "r2"),
    ]
    path = folder(documents=documents(rows + odd()))
    out = {r["doc_id"]: r for r in same_as_sql(queries.op9_licenses(spark, path), licenses.ORACLE, path, ("documents",))}
    assert (out[1]["license"], out[1]["origin"]) == ("MIT", "file")
    assert (out[2]["license"], out[2]["origin"], out[2]["from_dir"]) == ("MIT", "inherited", "r1/a")
    assert (out[3]["license"], out[3]["origin"]) == ("Apache-2.0", "header")
    assert out[4]["origin"] == "none" and out[5]["license"] is None and out[8]["origin"] == "inherited"


def test_nearest_directory(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([
        ("LICENSE", "Released under the MIT License."), ("a/b/COPYING", "Licensed under CC BY-NC 4.0.\n" + "and words " * 40), ("a/b/c/x.py", "1"),
        ("a/x.py", "1"), ("y.py", None), (None, "1"), ("a/b/c/x.py", "1"),
    ], "path string, text string")
    out = sorted((r["path"], r["license"], r["origin"], r["from_dir"]) for r in licenses.scan(files, F.col("path")).collect() if r["from_dir"] is not None)
    assert out == [("", "MIT", "inherited", ""), ("a/b/c/x.py", "CC-BY-NC-4.0", "inherited", "a/b"),
                   ("a/b/c/x.py", "CC-BY-NC-4.0", "inherited", "a/b"), ("a/x.py", "MIT", "inherited", ""), ("y.py", "MIT", "inherited", "")]
    assert licenses.scan(files.limit(0), F.col("path")).count() == 0
