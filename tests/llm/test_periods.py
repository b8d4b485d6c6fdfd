"""Periodic runs against a plain search over all periods, and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from conftest_llm import prose

from dqspark.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs (start, end, period) by trying every period at every place."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def made_periodic(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]


def digest(doc_id, text):
    w = made_periodic(doc_id, WORD.findall(text or ""))
    runs = brute(w)
    keep = [True] * len(w)
    for s, e, q in runs:
        keep[s + q : e] = [False] * (e - s - q)
    best = min(runs, key=lambda r: (-((r[1] - r[0]) / r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)),
            sha(" ".join(x for x, k in zip(w, keep, strict=True) if k)))


def runs_of_words(w):
    return next(periods.periodic([" ".join(w).encode()]))[0]


def test_transform_multiplies_exactly():
    rng = np.random.default_rng(3)
    for prime, root in periods.PRIMES:
        a, b = (rng.integers(0, prime, (3, 16)).astype(np.uint64) for _ in "ab")
        b[:, 9:] = 0
        got = periods.correlations(b[:, :9], a, 16, prime, root)[:, :8]
        want = [[sum(int(b[r, i]) * int(a[r, i + s]) for i in range(9)) % prime for s in range(8)] for r in range(3)]
        assert got.tolist() == want


@pytest.mark.parametrize("seed", range(60))
def test_random_words(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 else "abcdefghij"
    w = []
    while len(w) < 400:
        part = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 12, 15, 17, 30, 40]))]
        w += part * rng.choice([1, 1, 2, 3, 4, 9])
        if rng.random() < 0.3:
            w[-1] = "z"
    assert runs_of_words(w) == brute(w)


@pytest.mark.parametrize("q", [1, 2, 7, 8, 9, 10, 12, 15, 16, 17, 31, 32, 33, 63, 64, 100, 127])
@pytest.mark.parametrize("offset", [0, 5, 13])
def test_shortest_runs(q, offset):
    unit = prose(q, q) if q > 1 else ["a"]
    unit = [f"{x}{i}" for i, x in enumerate(unit)]
    length = max(24, 3 * q)
    for n in (length - 1, length, length + 3):
        w = [*prose(1, offset), *(unit[i % q] for i in range(n)), *prose(2, 30)]
        found = runs_of_words(w)
        assert found == brute(w) and len(found) == int(n >= length)


def test_long_uniform_and_nested():
    w = ["a"] * 30_000
    assert runs_of_words(w) == [(0, 30_000, 1)]
    unit = ["a"] * 30 + ["b"] * 30 + ["a"] * 40
    w = unit * 4
    assert runs_of_words(w) == brute(w)
    w = (["a"] * 700 + ["b"]) * 2 + ["a"] * 300
    assert runs_of_words(w) == brute(w)


def test_texts_do_not_touch(monkeypatch):
    half = " ".join(["a b c"] * 5).encode()
    assert [r for r, _ in periods.periodic([half, half, None, b"", half])] == [[]] * 5
    whole = " ".join(["a b c"] * 9).encode()
    for room in (1, 30, 1 << 19):
        monkeypatch.setattr(periods, "BATCH_WORDS", room)
        assert [r for r, _ in periods.periodic([half, whole, b" ", whole])] == [[], [(0, 27, 3)], [], [(0, 27, 3)]]


def test_query_on_odd_rows(spark, documents, folder):
    rows = [(i, " ".join(prose(i, 50 + 7 * i))) for i in range(40)]
    rows += [(41, None), (42, ""), (43, " \t\n"), (44, "x"), (None, "a b " * 40), (None, None), (1, rows[1][1])]
    rows += [(45, "same line here\n" * 50), (46, "ä\x0bß\x0c\r" * 30), (47, "a\x00b  c " * 30), (48, "w " * 100_000), (49, "z" * 300_000)]
    rows += [(i, " ".join(prose(i, 120))) for i in range(50, 90)]
    got = queries.op12_periods(spark, folder(documents=documents(rows)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    heavy = {48}
    want = [digest(*r) for r in rows if r[0] not in heavy]
    assert sorted(map(str, (tuple(r) for r in got.collect() if r["doc_id"] not in heavy))) == sorted(map(str, want))
    assert queries.op12_periods(spark, folder(documents=documents([]))).count() == 0


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [digest(r["doc_id"], r["text"]) for r in docs if len((r["text"] or "").split()) < 3000]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periods(spark, SF).collect()}
    assert len(got) == len(docs)
    assert [got[w[0]] for w in want] == want


def test_carried_columns(spark, documents):
    out = periods.find_runs(documents([(1, "a " * 30), (2, "b")]).withColumnRenamed("kept", "runs"))
    assert "score" in out.columns and [len(r["runs"]) for r in out.orderBy("doc_id").collect()] == [1, 0]
