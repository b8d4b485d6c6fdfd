import itertools
from collections import Counter, defaultdict

import pytest
from conftest_llm import prose

from dqspark.llm import components, neardup


def brute(rows):
    """Component of each row by all pairs over word tuples."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    holders, common = defaultdict(list), Counter()
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        common.update(itertools.combinations(held, 2))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), c in common.items():
        if 100 * c >= 75 * (len(sets[i][1]) + len(sets[j][1]) - c):
            a, b = find(sets[i][0]), find(sets[j][0])
            root[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus():
    """Copies, near copies of many degrees, chains, a passage in common, short and empty texts."""
    rows, base = [], prose(1, 120)
    for i in range(40):
        w = list(base)
        for k in range(i % 6):
            w[(37 * i + 11 * k) % 120] = f"edit{i}x{k}"
        rows.append(" ".join(w))
    rows += [rows[3]] * 5 + [rows[3].upper(), rows[4].replace(" ", "\n\t")]
    passage = prose(2, 40)
    rows += [" ".join(passage + prose(100 + i, 10 + i)) for i in range(40)]
    chain = prose(3, 200)
    rows += [" ".join(chain[i * 4 : i * 4 + 100]) for i in range(20)]
    rows += ["", None, "one two", "ONE two", "a b c d e", "a b c d e f", " \n ", "é É"]
    return [(1000 - 7 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [neardup.SMALL, 2])
def test_equals_all_pairs(documents, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # 2: every larger key takes the exact way
    rows = corpus()
    assert got(neardup.near_duplicates(documents(rows))) == brute(rows)


def test_nulls_repeats_long_texts(documents):
    long = " ".join(prose(5, 60_000))
    rows = [(1, "x y z"), (1, "x y z"), (2, "x Y z"), (None, "x y z"), (3, None), (4, long), (5, long + " end")]
    out = neardup.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert by_id[3]["n_shingles"] == 0 and by_id[3]["component_id"] == 3
    assert by_id[5]["component_id"] == 4


def test_one_id_with_two_texts(documents):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "k l m n o p"), (9, "k l m n o p")]
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(rows)).collect()}
    assert set(out.values()) == {1}


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    out = dict(components.components(edges).collect())
    assert all(out[i] == 0 for i in range(61)) and out[101] == 100
