"""Characters and words of whole texts, counted over Arrow batches.

A table tells the classes of every code point; counts are differences of running sums, so a
batch costs a few passes over its characters whatever the classes are.  Classes are those of
Python's ``str`` predicates, as in ``functions.text``.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from dqspark.functions.travel import by_value

by_value(__name__)

CLASSES = ("alpha", "digit", "punct", "space", "upper", "odd")
COUNTS = ("chars", *CLASSES, "digit_runs", "tokens", "token_squares")
#: Bytes looked at together.
SLICE = 1 << 21


@lru_cache(maxsize=1)
def packed_classes() -> bytes:
    """A bit per class and code point, compressed to travel with the tasks."""
    table = np.full(0x110000, 1 << CLASSES.index("odd"), dtype=np.uint8)
    for c in range(0x33000):  # beyond it no character is a letter, digit, sign or blank
        ch, kind = chr(c), unicodedata.category(chr(c))
        bits = (
            kind[0] == "L", ch.isdigit(), ch in string.punctuation, ch.isspace(), kind == "Lu",
            not (0x20 <= c <= 0x7E or 0x09 <= c <= 0x0D),
        )
        table[c] = sum(1 << i for i, b in enumerate(bits) if b)
    return zlib.compress(table.tobytes())


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of texts without nulls, and where each text begins and the last one ends."""
    raw = texts.cast(pa.large_binary())
    places = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, places - places[0]


def count(texts: pa.Array, table: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The asked counts of texts without nulls.

    Classes stand at the first byte of a character; ASCII is translated byte by byte, other
    characters are decoded by themselves.
    """
    data, places = bytes_of(texts)
    kinds = np.frombuffer(bytearray(data.tobytes().translate(table[:0x80].tobytes() + bytes(0x80))), dtype=np.uint8)
    beyond = data >= 0x80
    later = np.zeros(0, dtype=np.int64)  # bytes after the first one of a character
    if beyond.any():
        inner = (data & 0xC0) == 0x80
        heads, later = np.flatnonzero(beyond & ~inner), np.flatnonzero(inner)
        points = np.frombuffer(data[beyond].tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        broken = len(points) != len(heads) or (len(points) and (points == 0xFFFD).any())
        if broken:
            sound = pa.array([b.decode("utf-8", "replace") for b in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
            if not sound.cast(pa.large_binary()).equals(texts.cast(pa.large_binary())):
                return count(sound, table, names)
        kinds[heads] = table[points]

    def up_to(found: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(found, places))

    def within(name: str) -> np.ndarray:
        return (kinds & (1 << CLASSES.index(name))) != 0

    def begins(inside: np.ndarray) -> np.ndarray:
        """Places where a run begins; ``inside`` is true for all bytes of its characters, no run goes on into the next text."""
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edge = places[:-1][places[:-1] < len(inside)]
        start[edge] = inside[edge]
        return np.flatnonzero(start)

    def whole(name: str) -> np.ndarray:
        """The class at every byte of its characters."""
        mask = within(name)
        for _ in range(3 if len(later) else 0):
            mask[later] = mask[later - 1]
        return mask

    out = {"chars": np.diff(places) - up_to(later)}
    for name in set(names) & set(CLASSES):
        out[name] = up_to(np.flatnonzero(within(name)))
    if "digit_runs" in names:
        out["digit_runs"] = up_to(begins(whole("digit")))
    if "tokens" in names:
        word = ~whole("space")
        start = begins(word)
        last = word.copy()
        last[:-1] &= ~word[1:]
        edge = places[1:] - 1
        edge = edge[edge >= 0]
        last[edge] = word[edge]
        end = np.flatnonzero(last) + 1
        lengths = end - start - (np.searchsorted(later, end) - np.searchsorted(later, start))
        squares = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) ** 2)])
        upto = np.searchsorted(start, places)
        out["tokens"] = np.diff(upto)
        out["token_squares"] = np.diff(squares[upto])
    return out


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about ``SLICE`` bytes together."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + SLICE, "right")))
        yield texts.slice(start, end - start)
        start = end


def counts(text: Column, names: tuple[str, ...] = COUNTS) -> Column:
    """Struct of the asked ``COUNTS`` of a text; all null for null."""
    packed = packed_classes()

    @F.arrow_udf(", ".join(f"{n} bigint" for n in names))
    def measure(batch: pa.Array) -> pa.Array:
        known = np.flatnonzero(np.asarray(batch.is_valid()))
        found = {n: np.zeros(len(batch), dtype=np.int64) for n in names}
        if len(known):
            table = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            parts = [count(part, table, names) for part in slices(batch.drop_null())]
            for n in names:
                found[n][known] = np.concatenate([p[n] for p in parts])
        null = np.ones(len(batch), dtype=bool)
        null[known] = False
        return pa.StructArray.from_arrays([pa.array(found[n], pa.int64(), mask=null) for n in names], list(names))

    return measure(text)


def tidy(text: Column) -> Column:
    """NFKC, blanks collapsed and trimmed, nothing left means null; case is kept."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        t = raw.decode("utf-8", "replace")
        return " ".join((t if t.isascii() else unicodedata.normalize("NFKC", t)).split()) or None

    @F.arrow_udf("string")
    def clean(batch: pa.Array) -> pa.Array:
        return pa.array([one(raw) for raw in batch.cast(pa.large_binary()).to_pylist()], pa.string())

    return clean(text)
