import hashlib
from collections import Counter

import pytest
from conftest_llm import prose

from dqspark.llm import suffixes


def brute(rows):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    text = lambda seed, n: " ".join(prose(seed, n))
    shared, rows = text(1, 80), []
    rows += [text(10 + i, 30) + " " + shared + " " + text(50 + i, 20) for i in range(12)]
    rows += [shared[:199], shared[:200], shared[5:205], text(2, 90), text(2, 90), "é" * 150 + text(3, 40) + "é" * 101]
    edited = text(4, 200)
    rows += [edited[:k] + "#" + edited[k + 1 :] for k in (0, 250, 500, 777)]
    rows += ["De " * 300, "De " * 90, "ab" * 400, text(6, 60) + " again " + text(6, 60), "", None, "x"]
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [suffixes.GROUP, 3])
def test_equals_brute_force(documents, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)  # 3: larger groups are counted by an aggregation
    rows = corpus()
    out = sorted((tuple(r) for r in suffixes.remove_repeats(documents(rows)).collect()), key=str)
    assert out == brute(rows)


def test_segments_agree(documents, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    rows = corpus()
    local = {t: suffixes.survey(t or "")[0] for _, t in rows}
    assert all(all(p >> 16 >= 0 for p in v) for v in local.values())
    # windows have the same anchor whatever the segment
    monkeypatch.undo()
    for t, cut in local.items():
        windows = lambda packed: {(p >> 16, w) for p in packed for w in range((p >> 16) - (p >> 8 & 255), (p >> 16) - (p & 255) + 1)}
        assert windows(cut) == windows(suffixes.survey(t or "")[0]) or suffixes.survey(t or "")[2]


def test_nulls_and_repeated_rows(documents):
    long = " ".join(prose(9, 300))
    rows = [(1, long), (1, long), (None, long + "?"), (None, None), (2, "short"), (2, "short"), (3, long[:210]), (3, "other " * 3)]
    out = sorted((tuple(r) for r in suffixes.remove_repeats(documents(rows)).collect()), key=str)
    assert out == brute(rows)


def test_very_long_text(documents):
    part = " ".join(prose(7, 60_000))
    rows = [(1, part + " middle " + part[:5000]), (2, part[1000:3000])]
    out = {r["doc_id"]: r for r in suffixes.remove_repeats(documents(rows)).collect()}
    assert out[1]["n_removed"] == 10_000 and out[2]["n_removed"] == 2000


def test_empty_table(documents):
    assert suffixes.remove_repeats(documents([])).count() == 0
