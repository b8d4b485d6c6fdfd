"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per text: words, characters in words, symbols, repeated lines, and words that lie in a
3-word window met before or again.  A text fails the base rules with fewer than 50 words
or with more than half of its words in repeated windows.

Across texts: lines are normalised (lower case, white space to one space, digits to 0) and
hashed.  For each host the distinct texts that hold a line are counted; exact copies of a
text count once, so copying alone makes no boilerplate.  A line held by at least
``MIN_TEXTS`` texts and by more than ``SHARE`` of a host's texts is removed there, and a
text that loses more than half of its words is depleted and rejected.  ``judge`` gives the
verdicts and the words removed, ``clean_texts`` the texts without those lines.

Null texts have no words, so they fail; null hosts are one host of their own.  Rows are
judged by host and text, so repeated rows give repeated results.  Ids are only passed on,
further columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import GAP, GAP_CHARS, pin, text_of, words
from dqspark.operators.lookup import look_up

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MIN_TEXTS = 20
SHARE = 0.02
#: A list of lines to remove is broadcast only up to this many rows of 16 bytes and a host name.
BROADCAST_ROWS = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, for values that lambdas read again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(found: Column) -> Column:
    """Words inside a 3-word window found twice or more in the array of words."""

    def window_hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(starts: Column) -> Column:
        """Words covered by windows at the sorted starts."""
        gaps = F.transform(
            starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)))
        )
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def again(hashes: Column) -> Column:
        """Sorted starts of the windows whose hash occurs again."""
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(order, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | (F.get(s, j - 1)["h"] == x["h"])), lambda x: x["i"]
        )))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(again(hashes), covered)).otherwise(0)

    return let(found, lambda w: F.when(F.size(w) >= 3, let(window_hashes(w), count)).otherwise(0))


def base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Base measures of every row, with its host and text hash."""
    t = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_of(text).alias("t")
    )
    w = t.withColumns({"w": words(F.col("t")), "lines": F.filter(
        F.split("t", "\n"), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")})
    return w.select(
        "doc_id", "host", F.xxhash64("t").alias("text_hash"), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normalised(line: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(F.btrim(line, F.lit(GAP_CHARS)), GAP, " ")), "123456789", "000000000")


def line_table(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, text_hash, line, n): words under each distinct line of each distinct text, summed over its copies."""
    rows = docs.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_of(text)).alias("text_hash"),
        F.explode(F.split(text_of(text), "\n")).alias("l"),
    ).withColumn("n", F.size(words(F.col("l")))).filter("n > 0")
    return rows.groupBy("host", "text_hash", F.xxhash64(normalised(F.col("l"))).alias("line")).agg(F.sum("n").alias("n"))


def common_lines(lines: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """(host, line) above the limits."""
    texts = lines.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") >= min_texts)
    return held.join(texts, "host").filter(F.col("holders") > share * F.col("texts")).select("host", "line")


def common_in(lines: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """The rows of ``lines`` whose line is removed; lines of a host are spread where the list is long."""
    return look_up(lines, common_lines(lines, min_texts, share), ["host", "line"], "inner", BROADCAST_ROWS)


def losses(lines: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """(host, text_hash, removed, words, depleted) of texts that lose words with the common lines, words summed over copies."""
    lost = common_in(lines, min_texts, share).groupBy("host", "text_hash").agg(F.sum("n").alias("removed"))
    words_of = lines.groupBy("host", "text_hash").agg(F.sum("n").alias("words"))
    return words_of.join(lost, ["host", "text_hash"]).select(
        "host", "text_hash", "removed", "words", (2 * F.col("removed") > F.col("words")).alias("depleted")
    )


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_texts: int = MIN_TEXTS, share: float = SHARE,
) -> DataFrame:
    """One row per input row: base measures, ``n_removed_words``, ``base_failed`` and ``kept``."""
    lines = pin(line_table(docs, text, host), "lines")
    return look_up(base(docs, doc_id, text, host), losses(lines, min_texts, share), ["host", "text_hash"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce(F.expr("removed * n_words div words"), F.lit(0)).cast("long").alias("n_removed_words"), "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("depleted"), F.lit(False))).alias("kept"),
    )


def clean_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_texts: int = MIN_TEXTS, share: float = SHARE,
) -> DataFrame:
    """(doc_id, text): every row's text without its common lines, the others in their order.

    Lines without words stay, and a text that holds no common line stays as it is, null
    too.  A text that is all common lines becomes empty.  Depleted texts are cleaned like
    the others; ``judge`` tells which they are.
    """
    lines = pin(line_table(docs, text, host), "lines")
    gone = common_in(lines, min_texts, share).groupBy("host", "text_hash").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_of(text)).alias("text_hash"),
    )
    stays = lambda x: (F.btrim(x, F.lit(GAP_CHARS)) == "") | ~F.array_contains("gone", F.xxhash64(normalised(x)))
    cleaned = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    return look_up(rows, gone, ["host", "text_hash"]).select(
        "doc_id", F.when(F.col("gone").isNotNull(), cleaned).otherwise(F.col("text")).alias("text")
    )


_LIST = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: The same in DuckDB, over texts instead of hashes.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, host, t, {_LIST.format("t")} AS w FROM d
), tri AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM again GROUP BY r
), line AS (
  SELECT r, host, t, l, len({_LIST.format("l")}) AS n,
    translate(lower(regexp_replace(trim(l, E' \\t\\n\\x0b\\f\\r'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '123456789', '000000000') AS k
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS l FROM d)
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM line WHERE n > 0 GROUP BY r
), held AS (
  SELECT host, k, count(DISTINCT t) AS c FROM line WHERE n > 0 GROUP BY host, k
), texts AS (
  SELECT host, count(DISTINCT t) AS c FROM line WHERE n > 0 GROUP BY host
), common AS (
  SELECT held.host, held.k FROM held JOIN texts ON held.host = texts.host WHERE held.c >= {MIN_TEXTS} AND held.c > {SHARE} * texts.c
), lost AS (
  SELECT line.r, sum(line.n) AS n, sum(CASE WHEN common.k IS NULL THEN 0 ELSE line.n END) AS gone
  FROM line LEFT JOIN common ON line.host = common.host AND line.k = common.k WHERE line.n > 0 GROUP BY line.r
), m AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(w.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.gone, 0) AS BIGINT) AS n_removed_words,
    coalesce(2 * lost.gone > lost.n, false) AS depleted
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN dup ON w.r = dup.r LEFT JOIN lost ON w.r = lost.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept
FROM m
"""
