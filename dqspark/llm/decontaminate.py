"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

An item of L words is compared with windows of L words of the documents.

1. Words are lower-cased in A-Z; a shingle is the 64-bit hash of 5 words in a row (of a
   shorter text, of all its words).  Windows are formed at every shared shingle that
   either starts a run of shared shingles or has a shared shingle in the window's last
   place.  Some window of these is at least as similar as any other: a window moved right
   over a shingle that is not shared, or left onto a shared one while its last is not,
   loses nothing, and what cannot be moved so is formed (or is the text's last window).
2. Each window and each item has a 64-bit SimHash of its shingles, every occurrence
   weighing one.  Fingerprints are cut into ``BLOCKS`` blocks; an item is filed under every
   block value within ``BLOCK_RADIUS`` bits.  Two fingerprints within ``RADIUS`` bits have
   a block within that, so the join on (L, block, value) finds all of them.
3. Candidates within ``RADIUS`` are confirmed by the weighted similarity of the two
   multisets of shingles: sum of minima over sum of maxima, at least 0.75.

At similarity 0.75 the fingerprints' distance is binomial with mean 11 of 64; it exceeds
23 once in 11,000 such pairs.

Null or empty documents and items match nothing, nor does an empty table; an item under five
words matches only a document that is that sequence.  Repeated items count as one each; rows
of equal text get equal results; ids are passed on, null or not.  Texts of any length are cut
into all their windows; further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import LOWER, UPPER, likely_in, lower_ascii, pin, text_of, words
from dqspark.llm.linerules import let

SHINGLE = 5
BLOCKS = 8
BLOCK_RADIUS = 2
BITS = 64 // BLOCKS
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Item shingles and filed blocks are broadcast only up to so many rows of at most 40 bytes.
BROADCAST_ROWS = 200_000
#: What a place of a text hears about an item: it is shared, follows a shared one, its window ends with one.
SHARED, AFTER_SHARED, ENDS_SHARED = 1, 2, 4


def shingles(found: Column) -> Column:
    """Hashes of the 5-word windows of an array of words; one hash of all of a shorter array."""

    def of(w: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])
        )
        return F.when(F.size(w) >= SHINGLE, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(found, of)


def simhash(window: Column) -> Column:
    """Bit b is set where more than half of the hashes have it."""

    def bit(b: Column, w: Column) -> Column:
        ones = F.aggregate(w, F.lit(0), lambda a, x: a + F.call_function("shiftright", x, b).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))
        return F.when(2 * ones > F.size(w), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return let(window, lambda w: F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: bit(b, w)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)
    ))


def blocks(fingerprint: Column) -> Column:
    """(block, value) of each block of the fingerprint."""
    mask = F.lit((1 << BITS) - 1).cast("bigint")
    return F.array(*[
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, b * BITS).bitwiseAND(mask).alias("value"))
        for b in range(BLOCKS)
    ])


def errors() -> Column:
    """All block values with at most ``BLOCK_RADIUS`` bits set."""
    return F.array(*[F.lit(v).cast("bigint") for v in range(1 << BITS) if v.bit_count() <= BLOCK_RADIUS])


def checked(small: DataFrame, rows: int) -> DataFrame:
    """With a broadcast hint where the counted rows are few, else as it is."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, size, shingles, fingerprint) of items with words."""
    w = benchmark.select(F.col(item_id).cast("long").alias("item_id"), words(lower_ascii(text_of(text))).alias("w"))
    s = w.select("item_id", F.size("w").alias("size"), shingles(F.col("w")).alias("shingles")).filter("size > 0").distinct()
    return s.withColumn("fingerprint", simhash(F.col("shingles")))


def window_starts(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(text_hash, size, place): the windows of a text that can be the most similar to an item.

    Each shared shingle tells three places about itself: its own, the next one, and the one
    whose window ends with it.  What a place hears is one small number, combined in the tasks.
    """
    filed = pin(items.select("item_id", "size", F.explode("shingles").alias("h")).distinct(), "item-shingles")
    each = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), words(lower_ascii(text_of(text))).alias("w")).select(
        "text_hash", F.posexplode(shingles(F.col("w"))).alias("place", "h")
    )
    n = filed.count()
    if n > BROADCAST_ROWS:  # too many to broadcast: only shingles that may be an item's are moved
        each = likely_in(each, F.col("h"), filed, "h")
    hits = each.join(checked(filed, n), "h")
    tell = lambda place, what: F.struct(place.cast("int").alias("place"), F.lit(what).alias("heard"))
    told = hits.select("text_hash", "item_id", "size", F.explode(F.array(
        tell(F.col("place"), SHARED), tell(F.col("place") + 1, AFTER_SHARED), tell(F.col("place") - length_of(F.col("size")) + 1, ENDS_SHARED),
    )).alias("told")).select("text_hash", "item_id", "size", "told.*")
    heard = told.groupBy("text_hash", "item_id", "size", "place").agg(F.bit_or("heard").alias("heard"))
    has = lambda what: F.col("heard").bitwiseAND(F.lit(what)) > 0
    return heard.filter(has(SHARED) & (~has(AFTER_SHARED) | has(ENDS_SHARED))).select("text_hash", "size", "place").distinct()


def length_of(size: Column) -> Column:
    """Shingles of an item of ``size`` words."""
    return F.greatest(F.lit(1), size - (SHINGLE - 1))


def common_of(a: Column, b: Column) -> Column:
    """Size of the common multiset; only hashes repeated in both are counted out."""

    def repeated(hashes: Column) -> Column:
        return let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1) == x)))

    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    more = F.aggregate(
        F.array_intersect(repeated(a), repeated(b)), F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h)) - 1
    )
    return F.size(F.array_intersect(a, b)) + more


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(text_hash, item_id) of every confirmed window."""
    items = pin(items_of(benchmark), "items")
    starts = pin(window_starts(docs, items, text), "starts")
    per_text = starts.groupBy("text_hash").agg(F.collect_set(F.struct("size", "place")).alias("starts"))
    texts = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    # only texts with a hit, and few others, are moved
    touched = likely_in(texts, F.col("text_hash"), starts, "text_hash").join(per_text, "text_hash")
    cut = touched.select(
        "text_hash", "starts", shingles(words(lower_ascii(F.col("text")))).alias("s")
    ).select("text_hash", "s", F.explode("starts").alias("start"))
    length = length_of(F.col("start.size"))
    first = F.greatest(F.lit(0), F.least(F.col("start.place"), F.size("s") - length))
    window = pin(
        cut.select("text_hash", F.col("start.size").alias("size"), F.slice("s", first + 1, length).alias("window"))
        .withColumn("fingerprint", simhash(F.col("window"))).distinct(), "windows",
    )
    near = F.explode(F.transform(errors(), lambda e: F.col("b.value").bitwiseXOR(e)))
    filed = items.select("item_id", "size", F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks(F.col("fingerprint"))).alias("b"))
    filed = pin(filed.select("item_id", "size", "item_fingerprint", F.col("b.block").alias("block"), near.alias("value")), "filed")
    asked = window.select("text_hash", "size", "fingerprint", F.explode(blocks(F.col("fingerprint"))).alias("b")).select(
        "text_hash", "size", "fingerprint", F.col("b.block").alias("block"), F.col("b.value").alias("value")
    )
    near_pairs = asked.join(checked(filed, filed.count()), ["size", "block", "value"]).filter(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS
    ).select("text_hash", "size", "fingerprint", "item_id", "item_fingerprint").distinct()
    known = items.select("item_id", "size", F.col("fingerprint").alias("item_fingerprint"), "shingles")
    both = near_pairs.join(checked(known, known.count()), ["item_id", "size", "item_fingerprint"]).join(
        window, ["text_hash", "size", "fingerprint"]
    )
    union = F.size("window") + F.size("shingles") - F.col("common")
    return both.withColumn("common", common_of(F.col("window"), F.col("shingles"))).filter(100 * F.col("common") >= 75 * union).select("text_hash", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) of every row; ``item_ids`` in order, comma-joined."""
    found = matches(docs, benchmark, text).groupBy("text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"))
    return rows.join(found, "text_hash", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"),
    )


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: The same over shingles as text, every window that holds a shingle of an item against every item of its size.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
dn AS (SELECT r, len(w) AS n, w, greatest(1, len(w) - 4) AS m FROM d WHERE len(w) > 0),
bn AS (SELECT item_id, len(w) AS n, w, greatest(1, len(w) - 4) AS m FROM b WHERE len(w) > 0),
ds AS (SELECT r, n, m, p, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT r, n, m, w, unnest(range(1, m + 1)) AS p FROM dn)),
bs AS (SELECT item_id, n, m, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT item_id, n, m, w, unnest(range(1, m + 1)) AS p FROM bn)),
hit AS (SELECT DISTINCT ds.r, bs.item_id, bs.n AS size, bs.m AS length, ds.p, ds.m FROM ds JOIN bs ON ds.g = bs.g),
start AS (
  SELECT DISTINCT r, size, length, greatest(1, least(s, m - length + 1)) AS s
  FROM (SELECT *, unnest(range(p - length + 1, p + 1)) AS s FROM hit)
),
cw AS (
  SELECT start.r, start.size, start.s, ds.g, count(*) AS c
  FROM start JOIN ds ON ds.r = start.r AND ds.p >= start.s AND ds.p < start.s + start.length GROUP BY ALL
),
nw AS (SELECT r, size, s, sum(c) AS c FROM cw GROUP BY ALL),
ci AS (SELECT item_id, n AS size, m, g, count(*) AS c FROM bs GROUP BY ALL),
both_ AS (
  SELECT cw.r, cw.size, cw.s, ci.item_id, ci.m, sum(least(cw.c, ci.c)) AS common
  FROM cw JOIN ci ON cw.size = ci.size AND cw.g = ci.g GROUP BY ALL
),
good AS (
  SELECT DISTINCT both_.r, both_.item_id FROM both_ JOIN nw ON both_.r = nw.r AND both_.size = nw.size AND both_.s = nw.s
  WHERE 100 * common >= 75 * (nw.c + both_.m - common)
),
per AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids FROM good GROUP BY r)
SELECT d.doc_id, per.r IS NOT NULL AS contaminated, CAST(coalesce(per.n, 0) AS BIGINT) AS n_items, coalesce(per.ids, '') AS item_ids
FROM d LEFT JOIN per ON d.r = per.r
"""
