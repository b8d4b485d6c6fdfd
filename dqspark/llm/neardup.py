"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (words are
lower-cased in A-Z; a text of fewer words is one shingle; no words, no set).  Its
signature has ``CHUNKS * WIDTH`` min-hashes of 32 bits.  Two signatures that differ in at
most ``2 * CHUNKS - 1`` positions have, by the pigeonhole principle, a chunk of ``WIDTH``
positions with at most one error.  For every chunk each place of that error is enumerated:
the other positions of the chunk form a key, and documents that share any key are
candidates.  So every pair within that distance is a candidate without fail.  For sets of
similarity 0.75 the number of differing positions is binomial (30, 1/4); it exceeds 19 with
a probability of 2e-6, and most pairs beyond the distance share a key as well.  All
candidates are confirmed on the full sets.

Equal sets are one node from the start.  A key held by more than ``SMALL`` nodes is not
expanded into pairs.  Its nodes are compared with one centre each, and then take part in an
exact prefix join: shingles are ordered by the number of such nodes that have them, rarest
first; two sets with similarity 0.75 share one of the first n/4 + 1.  A prefix shingle held
by more than ``SMALL`` nodes again gets a centre, and after the components are known only
nodes of different components that share it, and can still reach the similarity by size
and position, are compared.  No link is left out on any of these ways.

Rows with a null ``doc_id`` keep a null component and stay.  Rows that share a ``doc_id``
count as one document and get the same component.  Null and empty texts have an empty set
and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, pin, text_of
from dqspark.llm.components import components

by_value(__name__)

SHINGLE = 5
CHUNKS = 10
WIDTH = 3
SMALL = 24

_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_PLACE = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_SALT = _RANDOM.integers(1, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64)
_ODD = _RANDOM.integers(1, 1 << 62, CHUNKS * WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_MIX = _U(0x9E3779B97F4A7C15)


def similar(common: Column, a: Column, b: Column) -> Column:
    """100 * intersection >= 75 * union in whole numbers."""
    return 100 * common >= 75 * (a + b - common)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, _U(size), dtype=np.uint64)
    for j in range(size):
        h += w[j : len(w) - size + 1 + j] * _PLACE[j]
    h ^= h >> _U(31)
    h *= _MIX
    h ^= h >> _U(29)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest value of each salted hash, as signed integers."""
    low = np.full(len(_SALT), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 8192):
        x = (hashes[None, i : i + 8192] ^ _SALT[:, None]) * _ODD[:, None]
        x ^= x >> _U(32)
        x *= _MIX
        low = np.minimum(low, x.min(axis=1))
    return (low >> _U(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, set_id, sig) of every row with an id; ``set_id`` is a 128-bit digest of the set."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n": [len(s) for s in sets],
                "set_id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "sig": [signature(s) if len(s) else None for s in sets],
            })

    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInPandas(measure, "doc_id long, n int, set_id binary, sig array<int>")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(doc_id, n, sig, node): ``node`` is the smallest id with the same set; an empty set is its own."""
    first = rows.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "set_id", "left").select("doc_id", "n", "sig", F.coalesce("first", "doc_id").alias("node"))


def keys(sig: Column) -> Column:
    """One key for each chunk and place of its allowed error."""
    out = []
    for chunk in range(CHUNKS):
        for wrong in range(WIDTH):
            kept = [sig[chunk * WIDTH + j] for j in range(WIDTH) if j != wrong]
            out.append(F.xxhash64(F.lit(chunk * WIDTH + wrong), *kept))
    return F.array(*out)


def comparable(a: Column, b: Column) -> Column:
    """Set sizes that allow the similarity."""
    return (4 * F.least(a, b)) >= (3 * F.greatest(a, b))


def members_of(keyed: DataFrame) -> DataFrame:
    """Rows of keys held by two nodes or more, with the key's size and its smallest node as centre."""
    held = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("centre"), F.max("node").alias("last")
    ).filter("centre < last")
    return keyed.join(held.drop("last"), "key")


def candidate_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of small keys, each node with the centre of large ones."""
    small = members.filter(F.col("size") <= SMALL)
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("m"))
    within = small.select("key", F.col("node").alias("a"), "n").join(other, "key").filter(
        (F.col("a") < F.col("b")) & comparable(F.col("n"), F.col("m"))
    ).select("a", "b").distinct()
    star = members.filter((F.col("size") > SMALL) & (F.col("node") > F.col("centre"))).select(
        F.col("centre").alias("a"), F.col("node").alias("b")
    ).distinct()
    sizes = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"))
    star = star.join(sizes, "a").join(nodes.select(F.col("node").alias("b"), "n"), "b").filter(
        comparable(F.col("n"), F.col("m"))
    ).select("a", "b")
    return within.unionAll(star)


def within_distance(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures differ in at most ``2 * CHUNKS - 1`` positions."""
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    agree = sum((F.col("sig_a")[i] == F.col("sig_b")[i]).cast("int") for i in range(CHUNKS * WIDTH))
    return pairs.join(left, "a").join(right, "b").filter(agree >= CHUNKS * WIDTH - (2 * CHUNKS - 1)).select("a", "b")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity.  The texts travel, as they are smaller than the sets."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[text] = shingle_set(text)
            return known[text]

        for batch in batches:
            good = []
            for s, t in zip(batch["text_a"], batch["text_b"], strict=True):
                x, y = of(s), of(t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.loc[good, ["a", "b"]]

    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    centre = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(other, "b").join(centre, "a").select("a", "b", "text_a", "text_b").mapInPandas(judge, "a long, b long")


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, node, n, place) of the rarest n / 4 + 1 shingles of each node, those of one node only left out.

    Rarity is counted over the given nodes.  ``place`` is the position in the order.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in batch["text"]]
            sizes = [len(s) for s in sets]
            yield pd.DataFrame({
                "node": np.repeat(batch["node"].to_numpy(), sizes), "row": np.repeat(batch["row"].to_numpy(), sizes),
                "key": np.concatenate(sets) if sets else np.empty(0, dtype=np.int64),
            })

    rows = texts.select("node", F.xxhash64("text").alias("row"), "text").mapInPandas(expand, "node long, row long, key long")
    rows = pin(rows, "shingles")
    df = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    lists = rows.join(df, "key").groupBy("node", "row").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("all"))
    n = F.size("all")
    first = F.slice("all", 1, F.floor(n / 4).cast("int") + 1)
    return lists.select("node", n.alias("n"), F.posexplode(first).alias("place", "s")).filter("s.df > 1").select(
        F.col("s.key").alias("key"), "node", "n", "place"
    )


def rest_pairs(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of large prefix keys whose nodes are in different components and may reach the similarity."""
    large = prefix.filter(F.col("size") > SMALL).join(labels, "node", "left").select(
        "key", "node", "n", "place", F.coalesce("component", "node").alias("component")
    )
    mixed = large.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    large = large.join(mixed.select("key"), "key", "left_semi")
    u = large.select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "place", "component")])
    v = large.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "component")])
    # the rarest shingle two sets share bounds what they can share after it
    reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return u.join(v, "key").filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        & comparable(F.col("n_a"), F.col("n_b")) & (7 * reach >= 3 * (F.col("n_a") + F.col("n_b")))
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def one_document(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows that share an id."""
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last")
    return rows.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``component_id`` is the smallest id reachable over links of similarity 0.75 or more,
    the row's own included; ``kept`` marks the row with that id.
    """
    rows = pin(nodes_of(pin(sketch(docs, doc_id, text), "sketch")), "nodes")
    nodes = rows.filter("n > 0 and doc_id = node").select("node", "n", "sig")
    keyed = nodes.select(F.explode(keys(F.col("sig"))).alias("key"), "node", "n")
    members = pin(members_of(keyed), "members")
    involved = members.select("node").distinct()
    texts = pin(
        docs.select(F.col(doc_id).cast("long").alias("node"), text_of(text).alias("text")).join(involved, "node"), "texts"
    )
    # pairs are written before texts are joined to them: smaller plans take less of the driver
    pairs = pin(within_distance(candidate_pairs(members, nodes), nodes), "pairs")
    hot = members.filter(F.col("size") > SMALL).select("node").distinct()
    prefix = None
    if not hot.isEmpty():
        prefix = pin(members_of(prefixes(texts.join(hot, "node", "left_semi"))), "prefixes")
        pairs = pairs.unionAll(pin(candidate_pairs(prefix, nodes), "prefix-pairs")).distinct()
    links = pin(confirm(pairs, texts).unionAll(one_document(rows)), "links")
    labels = components(links)
    if prefix is not None and not prefix.filter(F.col("size") > SMALL).isEmpty():
        more = confirm(pin(rest_pairs(prefix, labels), "rest-pairs"), texts)
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    named = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    judged = named.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("doc_id") == F.col("component")).alias("kept"),
    )
    return judged.unionAll(without_id(docs, doc_id, text))


def without_id(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows without an id: measured, in no component, kept."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(shingle_set(t)) for t in batch])

    return docs.filter(F.col(doc_id).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.pandas_udf(count, "long")(text_of(text)).alias("n_shingles"),
        F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"),
    )
