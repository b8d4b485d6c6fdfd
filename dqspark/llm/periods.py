"""Periodic runs of words: stretches that repeat a block of q words at least three times.

A run is a stretch of words with smallest period q, at least ``max(24, 3 q)`` words long, that
no neighbouring word extends keeping period q.  Runs are found by block convolution.  At the
scale L = 8, 16, 32 ... the words are cut into blocks of L.  A run of period L <= q < 2 L (at
the first scale q < 16) covers some whole block together with its copy q words later, so it is
enough to know where each block occurs again at distances L to 2 L - 1.  The sums of squared
differences of a block and all these places are sum a^2 + sum b^2 - 2 sum a b, and the last is
a correlation, taken by a number-theoretic transform over all blocks of a batch at once.  Word
numbers and block sizes are bounded, so with two primes (one where that is enough) the sums are
exact integers and zero means equal words.  Each such distance seeds an extension to both sides.

Two things save work and lose nothing.  A block that holds a word which does not come again at
those distances cannot match.  And a match inside a run known from a smaller scale, whose
period is at most L, is a multiple of that run's period and would be extended to the same run.

Everything happens within a document, so Spark moves no rows: batches of documents go through
one Arrow function, cut so that at most ``BATCH_WORDS`` words (or one document) are at work.

Words are maximal runs without white space of the whole text; a null or empty text has none
and gets no runs and an empty collapsed text.  Very long texts take memory in proportion to
their words.  Repeated rows get the same result each, ties between runs do not matter as all
are returned, further columns are carried, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, text_of, words

by_value(__name__)

LEAST_WORDS, LEAST_TIMES = 24, 3
FIRST_SCALE = 8
BATCH_WORDS = 1 << 19
#: Primes 15 * 2^27 + 1 and 27 * 2^26 + 1 with a primitive root each; products fit 64 bits.
PRIMES = ((2013265921, 31), (1811939329, 13))
#: Numbers in one round of transforms.
_ROUND = 1 << 21

RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def transform(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Number-theoretic transform of every row (a power of two long)."""
    n = rows.shape[1]
    bits = n.bit_length() - 1
    place = np.arange(n)
    turned = np.zeros(n, dtype=np.int64)
    for k in range(bits):
        turned |= ((place >> k) & 1) << (bits - 1 - k)
    out, p = rows[:, turned] % np.uint64(prime), np.uint64(prime)
    half = 1
    while half < n:
        step = pow(root, (prime - 1) // (2 * half), prime)
        twist = np.ones(half, dtype=np.uint64)
        done = 1
        while done < half:  # powers of the step by doubling
            twist[done : 2 * done] = twist[:done] * np.uint64(pow(step, done, prime)) % p
            done *= 2
        pairs = out.reshape(len(out), -1, 2, half)
        low, high = pairs[:, :, 0, :].copy(), pairs[:, :, 1, :] * twist % p
        pairs[:, :, 0, :] = (low + high) % p
        pairs[:, :, 1, :] = (low + p - high) % p
        half *= 2
    return out


def correlations(blocks: np.ndarray, windows: np.ndarray, size: int, prime: int, root: int) -> np.ndarray:
    """Sum of products of each block with its window at every shift, modulo the prime."""
    reverse = np.zeros((len(blocks), size), dtype=np.uint64)
    reverse[:, 0] = blocks[:, 0]
    reverse[:, size - blocks.shape[1] + 1 :] = blocks[:, :0:-1]
    wide = np.zeros((len(windows), size), dtype=np.uint64)
    wide[:, : windows.shape[1]] = windows
    product = transform(reverse, prime, root) * transform(wide, prime, root) % np.uint64(prime)
    back = transform(product, prime, pow(root, prime - 2, prime))
    return back * np.uint64(pow(size, prime - 2, prime)) % np.uint64(prime)


def matches(numbers: np.ndarray, starts: np.ndarray, length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every block of ``length`` words that occurs again ``first`` to ``last`` words later.

    The numbers must end with enough words that occur nowhere else.
    """
    reach = last - first + length
    size = 1 << (reach - 1).bit_length()
    top = int(numbers.max(initial=0))
    primes = PRIMES[: 1 if length * top * top < PRIMES[0][0] else 2]
    found, apart = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(starts), max(1, _ROUND // size)):
        own = starts[at : at + max(1, _ROUND // size)]
        blocks = numbers[own[:, None] + np.arange(length)].astype(np.uint64)
        windows = numbers[own[:, None] + np.arange(first, first + reach)].astype(np.uint64)
        equal = True
        for prime, root in primes:
            p = np.uint64(prime)
            squares = (blocks % p) ** 2 % p
            ends = np.zeros((len(own), reach + 1), dtype=np.uint64)
            np.cumsum((windows % p) ** 2 % p, axis=1, out=ends[:, 1:])
            later = (ends[:, length:] - ends[:, :-length]) % p
            both = correlations(blocks, windows, size, prime, root)[:, : later.shape[1]]
            equal = equal & ((later + squares.sum(1, dtype=np.uint64)[:, None] % p + 2 * (p - both)) % p == 0)
        block, shift = np.nonzero(equal)
        found.append(own[block])
        apart.append(first + shift)
    return np.concatenate(found), np.concatenate(apart)


def stretch(numbers: np.ndarray, start: int, distance: int) -> tuple[int, int]:
    """The longest stretch around ``start`` in which words ``distance`` apart are equal."""
    right, step = start, 32
    while right + distance < len(numbers):
        same = numbers[right : right + step][: len(numbers) - right - distance] == numbers[right + distance : right + distance + step]
        if not same.all():
            right += int(same.argmin())
            break
        right, step = right + len(same), step * 2
    left, step = start, 32
    while left > 0:
        low = max(0, left - step)
        same = numbers[low:left] == numbers[low + distance : left + distance]
        if not same.all():
            left -= int(same[::-1].argmin())
            break
        left, step = low, step * 2
    return left, right + distance


def may_match(key: np.ndarray, order: np.ndarray, width: int, first: int, last: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Blocks all of whose words come again ``first`` to ``last`` words later.

    ``key`` is word number * ``width`` + place, ascending, and ``order`` the places in that order.
    """
    place = np.searchsorted(key, key + first)
    again = np.zeros(len(key) + 1, dtype=bool)
    inside = place < len(key)
    again[order[inside]] = key[place[inside]] <= key[inside] + last
    seen = np.concatenate([[0], np.cumsum(again[:-1])])
    return starts[seen[starts + length] - seen[starts] == length]


def runs_of(numbers: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in word numbers, of which no stretch over ``longest`` can be one.

    Texts that lie behind each other are parted by a number that occurs once.
    """
    n = len(numbers)
    if n < LEAST_WORDS:
        return []
    order = np.argsort(numbers, kind="stable")
    width = n + 2 * longest + 16
    key = numbers[order] * width + order
    runs: dict[tuple[int, int], int] = {}
    length = FIRST_SCALE
    while LEAST_TIMES * length <= longest or length == FIRST_SCALE:
        first, last = (1, 2 * length - 1) if length == FIRST_SCALE else (length, 2 * length - 1)
        starts = np.arange(0, n - length + 1, length)
        starts = may_match(key, order, width, first, last, starts, length)
        known, reach = reaches(runs)
        if len(known):  # every match of such a block lies inside a known run
            covered = reach[np.searchsorted(known, starts, side="right") - 1] >= starts + last + length
            starts = starts[~(covered & (starts >= known[0]))]
        padded = np.concatenate([numbers, numbers.max() + 1 + np.arange(last + length)])
        begin, apart = matches(padded, starts, length, first, last)
        by_distance = np.argsort(apart, kind="stable")
        begin, apart = begin[by_distance], apart[by_distance]
        distances, at = np.unique(apart, return_index=True)
        for distance, own in zip(distances.tolist(), np.split(begin, at[1:]), strict=False):
            if length == FIRST_SCALE:
                known, reach = reaches({k: q for k, q in runs.items() if q <= length})
            if len(known):
                inside = reach[np.searchsorted(known, own, side="right") - 1] >= own + distance + length
                own = own[~(inside & (own >= known[0]))]
            end = -1
            for start in own.tolist():
                if start + length + distance <= end:
                    continue
                left, end = stretch(numbers, start, distance)
                if end - left >= max(LEAST_WORDS, LEAST_TIMES * distance):
                    runs.setdefault((left, end), distance)
        length *= 2
    return sorted((s, e, q) for (s, e), q in runs.items())


def reaches(runs: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of known runs, ascending, and the furthest end of a run that starts there or before."""
    pairs = np.array(sorted(runs), dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]


def collapse(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside all repetitions, joined by single spaces."""
    if not runs:
        return b" ".join(found)
    keep = bytearray(b"\1") * len(found)
    for start, end, period in runs:
        keep[start + period : end] = bytes(end - start - period)
    return b" ".join([w for w, k in zip(found, keep, strict=True) if k])


def texts_at_once(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, in groups of at most ``BATCH_WORDS`` words or one text."""
    group, size = [], 0
    for text in texts:
        found = (text or b"").split()
        if group and size + len(found) > BATCH_WORDS:
            yield group
            group, size = [], 0
        group.append(found)
        size += len(found)
    if group:
        yield group


def periodic(texts: list[bytes | None]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs as (start, end, period) and the collapsed text, for every text."""
    for group in texts_at_once(texts):
        number: dict[bytes, int] = defaultdict(lambda: len(number))
        size = sum(len(g) + 1 for g in group)
        joined = np.empty(size, dtype=np.int64)
        at, begins = 0, []
        for found in group:
            begins.append(at)
            joined[at : at + len(found)] = list(map(number.__getitem__, found))
            at += len(found) + 1
        gaps = np.array([*begins[1:], size]) - 1
        joined[gaps] = len(number) + np.arange(len(gaps))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in group]
        for start, end, period in runs_of(joined, max(map(len, group))):
            k = int(np.searchsorted(begins, start, side="right")) - 1
            runs[k].append((start - begins[k], end - begins[k], period))
        for found, own in zip(group, runs, strict=True):
            yield own, collapse(found, own)


def repetition(text: Column) -> Column:
    """Struct of all ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text."""

    @F.arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, rows, collapsed = [0], [], []
            for own, rest in periodic(batch.cast(pa.binary()).to_pylist()):
                rows += [(s, e - s, q) for s, e, q in own]
                offsets.append(len(rows))
                collapsed.append(rest)
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["runs", "collapsed"])

    return find(text)


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The documents with all runs of their texts and the collapsed texts."""
    own = [c for c in docs.columns if c not in (runs, collapsed)]
    done = docs.select(*own, repetition(text_of(text)).alias("__periods"))
    return done.select(*own, F.col("__periods.runs").alias(runs), F.col("__periods.collapsed").alias(collapsed))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equals; null if there is none."""
    return F.aggregate(
        runs, F.get(runs, 0),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, or for a tenth of the ids its words made periodic from a hashed place on; as it is for a null id."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))

    def made(found: Column) -> Column:
        g, n = F.floor(h / 10), F.greatest(F.size(found), F.lit(1))
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(found, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(found, F.lit(1), a), again), " ")

    once = F.get(F.transform(F.array(words(text_of(text))), made), 0)  # the words are split once
    return F.when(h % 10 == 0, once).otherwise(text_of(text))
