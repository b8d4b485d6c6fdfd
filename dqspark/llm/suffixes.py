"""Removal of repeated byte strings: every byte under a string of ``SPAN`` bytes that also starts elsewhere.

A suffix sorter that induces all suffixes from a sample is the model: a sample of suffixes is
picked by content, sorted, and its order decides the rest.  Here

* the sample are *anchors*: in every window of ``SPAN`` bytes the place of the smallest hash
  of ``GRAM`` bytes (leftmost on ties).  Equal windows have their anchor at the same place,
  so windows are equal only if their anchors' tuples are;
* anchor tuples are grouped by Spark's external, spilling shuffle; anchors met once drop out;
* for anchors met again the bytes around them, as far as the windows that hang on the anchor
  reach, are sorted by anchor and compared, window by window, which decides every
  start position of the text.

Full recursion over all suffixes would sort one tuple a byte, which is more disk than the
limits allow (README); sampling keeps about 1.2 tuples per 100 bytes and loses nothing.

Texts count by content: rows with the same text share one identity (64-bit hash and
length), and a text with two rows or more is removed whole if it has ``SPAN`` bytes.
In texts of dense anchors (periodic text) repeats inside the text are found locally first.
A group of more than ``GROUP`` anchors is not brought to one task: its window hashes are
counted by an aggregation instead.

Null texts are empty; texts under ``SPAN`` bytes lose nothing; ids may be null or repeated,
each row is answered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, pin, text_of

by_value(__name__)

SPAN = 200
GRAM = 40
GROUP = 20_000
SEGMENT = 1 << 20

_U = np.uint64
_RANDOM = np.random.default_rng(19371215)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_RANDOM.integers(1, 1 << 61)) * 8 + 5
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            all_ = np.full(size, _U(base), dtype=np.uint64)
            all_[0] = 1
            _powers[i] = np.multiply.accumulate(all_)
    return _powers[0], _powers[1]


def window_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """64-bit hashes of all windows of each size; they depend on the bytes only, not on their place."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    out = []
    for size in sizes:
        n = max(0, len(data) - size + 1)
        h = (total[size : size + n] - total[:n]) * inverse[:n]
        h ^= h >> _U(30)
        h *= _MIX1
        h ^= h >> _U(27)
        h *= _MIX2
        h ^= h >> _U(31)
        out.append(h)
    return out


def anchors(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each anchor, given the hashes of all grams of a piece of text."""
    width = SPAN - GRAM + 1
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:  # smallest of the next `have` values, doubled until the window is covered
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def runs(starts: np.ndarray) -> list[list[int]]:
    """[start, stop) spans covered by SPAN bytes from each of the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > SPAN)
    lo, hi = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + SPAN
    return [list(map(int, x)) for x in zip(lo, hi, strict=True)]


def survey(text: str) -> tuple[list[int], list[int], list[list[int]]]:
    """Packed anchors, their gram hashes, and the spans that repeat inside the text (dense texts only).

    An anchor is packed as place * 65536 + (place - first window) * 256 + (place - last window).
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    packed, hashes, local = [], [], []
    for begin in range(0, max(0, len(data) - SPAN + 1), SEGMENT):
        piece = data[begin : begin + SEGMENT + SPAN - 1]
        (grams,) = window_hashes(piece, GRAM)
        at, first, last = anchors(grams)
        if len(at) > 100 and len(at) > 8 * len(piece) / (SPAN - GRAM):
            (whole,) = window_hashes(piece, SPAN)
            _, origin, inverse, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            local += [[a + begin, b + begin] for a, b in runs(np.flatnonzero(count[inverse] > 1))]
            new = np.zeros(len(whole) + 1, dtype=np.int64)
            new[origin + 1] = 1
            seen = np.cumsum(new)
            kept = seen[last + 1] > seen[first]
            at, first, last = at[kept], first[kept], last[kept]
        packed += (((at + begin) << 16) | ((at - first) << 8) | (at - last)).tolist()
        hashes += grams[at].view(np.int64).tolist()
    return packed, hashes, local


_SURVEY = (
    "doc_id long, text_id long, n_bytes long, sha string, packed array<long>, hashes array<long>, local array<array<int>>"
)


def surveyed(docs: DataFrame) -> DataFrame:
    """One row per document row: identity and size of its text, its anchors, its inner repeats."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import xxhash

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = text.encode("utf-8", "replace")
                packed, hashes, local = survey(text)
                rows.append((
                    None if pd.isna(doc_id) else int(doc_id), identity(data), len(data),
                    hashlib.sha256(data).hexdigest(), packed, hashes, local,
                ))
            out = pd.DataFrame(rows, columns=["doc_id", "text_id", "n_bytes", "sha", "packed", "hashes", "local"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.mapInPandas(measure, _SURVEY)


def identity(data: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).view(np.int64))


def contexts(touched: DataFrame, hot: bool) -> DataFrame:
    """(hash, text_id, n_bytes, start, around): the bytes of all windows that hang on each repeated anchor."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text_id, n, text, found in zip(batch["text_id"], batch["n_bytes"], batch["text"], batch["found"], strict=True):
                data = text.encode("utf-8", "replace")
                for a in found:
                    place, lo, hi = a["packed"] >> 16, a["packed"] >> 8 & 255, a["packed"] & 255
                    rows.append((a["hash"], text_id, n, place - lo, data[place - lo : place - hi + SPAN]))
            yield pd.DataFrame(rows, columns=["hash", "text_id", "n_bytes", "start", "around"])

    wanted = F.filter("found", lambda a: a["hot"] == hot)
    return touched.select("text_id", "n_bytes", "text", wanted.alias("found")).filter(F.size("found") > 0).mapInPandas(
        cut, "hash long, text_id long, n_bytes long, start int, around binary"
    )


def _windows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of every row, the row it is from, and its start in the row's bytes."""
    sizes = rows["around"].map(len).to_numpy()
    counts = sizes - SPAN + 1
    hashes = []
    for i in range(0, len(rows), 2000):  # hashed together, a bounded number of bytes at a time
        (h,) = window_hashes(np.frombuffer(b"".join(rows["around"].iloc[i : i + 2000]), dtype=np.uint8), SPAN)
        size, n = sizes[i : i + 2000], counts[i : i + 2000]
        base = np.repeat(np.cumsum(size) - size, n)
        hashes.append(h[base + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    row = np.repeat(np.arange(len(rows)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64), row, inner


def compare_groups(sorted_rows: DataFrame) -> DataFrame:
    """(text_id, n_bytes, spans) found in groups of rows of one anchor; partitions are sorted by anchor."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        h, row, inner = _windows(rows)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        on = np.flatnonzero(count[inverse] > 1)
        start = rows["start"].to_numpy(dtype=np.int64)
        cut = np.flatnonzero(np.diff(row[on])) + 1
        out = []
        for part in np.split(on, cut) if len(on) else []:
            r = row[part[0]]
            out.append((rows["text_id"].iat[r], rows["n_bytes"].iat[r], runs(inner[part] + start[r])))
        return pd.DataFrame(out, columns=["text_id", "n_bytes", "spans"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = held["hash"].to_numpy() != held["hash"].iat[-1]
            if whole.any():
                yield judge(held[whole].reset_index(drop=True))
                held = held[~whole].reset_index(drop=True)
        if held is not None:
            yield judge(held)

    return sorted_rows.mapInPandas(walk, "text_id long, n_bytes long, spans array<array<int>>")


def compare_hot(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many rows: windows are counted by hash, combined before the shuffle."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.iloc[i : i + 1000].reset_index(drop=True)
                h, row, inner = _windows(part)
                yield pd.DataFrame({
                    "h": h.view(np.int64), "text_id": part["text_id"].to_numpy()[row],
                    "n_bytes": part["n_bytes"].to_numpy()[row], "at": inner + part["start"].to_numpy()[row],
                })

    each = rows.mapInPandas(expand, "h long, text_id long, n_bytes long, at long")
    again = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    return each.join(again, "h", "left_semi").select(
        "text_id", "n_bytes", F.array(F.array(F.col("at").cast("int"), (F.col("at") + SPAN).cast("int"))).alias("spans")
    )


def cut_texts(touched: DataFrame, spans: DataFrame) -> DataFrame:
    """(text_id, n_bytes, n_removed, n_spans, kept_sha256) of the texts with spans."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for text_id, n, text, found in zip(batch["text_id"], batch["n_bytes"], batch["text"], batch["spans"], strict=True):
                data, merged = text.encode("utf-8", "replace"), []
                for lo, hi in sorted(tuple(map(int, s)) for group in found for s in group):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                kept, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    kept.update(data[at:lo])
                    at = hi
                kept.update(data[at:])
                rows.append((text_id, n, sum(hi - lo for lo, hi in merged), len(merged), kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["text_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    per_text = spans.groupBy("text_id", "n_bytes").agg(F.collect_list("spans").alias("spans"))
    return touched.select("text_id", "n_bytes", "text").join(per_text, ["text_id", "n_bytes"]).mapInPandas(
        cut, "text_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    known = pin(surveyed(rows), "anchors")
    each = known.select("text_id", "n_bytes", F.explode(F.arrays_zip("packed", "hashes")).alias("a")).select(
        F.col("a.hashes").alias("hash"), "text_id", "n_bytes", F.col("a.packed").alias("packed")
    )
    again = each.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash", (F.col("c") > GROUP).alias("hot"))
    found = each.join(again, "hash").groupBy("text_id", "n_bytes").agg(
        F.collect_set(F.struct("packed", "hash", "hot")).alias("found")
    )
    copies = known.groupBy("text_id", "n_bytes").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    inner = known.filter(F.size("local") > 0).select("text_id", "n_bytes", "local").distinct()
    wanted = found.join(inner, ["text_id", "n_bytes"], "full_outer").join(copies, ["text_id", "n_bytes"])
    touched = pin(texts_of(rows, wanted), "touched")
    groups = compare_groups(contexts(touched, hot=False).repartition("hash").sortWithinPartitions("hash"))
    spans = groups.unionAll(compare_hot(contexts(touched, hot=True))).unionAll(
        touched.filter("local is not null").select("text_id", "n_bytes", "local")
    )
    cut = cut_texts(touched, spans).dropDuplicates(["text_id", "n_bytes"])
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)
    return (
        known.select("doc_id", "text_id", "n_bytes", "sha")
        .join(copies.drop("doc_id"), ["text_id", "n_bytes"]).join(cut, ["text_id", "n_bytes"], "left")
        .select(
            "doc_id", "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted texts; an id that stands for several texts is told apart by content.

    Repeated rows give a text more than once, which changes nothing: such a text goes whole.
    """

    def name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([identity(t.encode("utf-8", "replace")) for t in batch], dtype="int64")

    ids = wanted.withColumnRenamed("doc_id", "wanted_id")
    joined = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    same = joined.filter(F.octet_length("text") == F.col("n_bytes")).withColumn("is", F.pandas_udf(name, "long")("text"))
    return same.filter(F.col("is") == F.col("text_id")).select("text_id", "n_bytes", "text", "found", "local")
