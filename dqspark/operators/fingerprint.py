"""Column fingerprints: 19 shape statistics per column, and sample values.

All columns are unpivoted into (column, value) and reduced together in two
shuffles, whatever their number.  Short values are first collapsed to distinct
ones and measured once each; long values are measured where they lie, and only
their digest and counts travel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions import chars
from dqspark.functions import text as tx
from dqspark.sources.durable import pin

# --- fixed values: feature order ---------------------------------------------
FEATURES = (
    "null_ratio", "cardinality_ratio", "distinct_count_log",
    "frac_alpha", "frac_digit", "frac_punct", "frac_space", "frac_upper_of_alpha",
    "avg_value_length", "std_value_length", "avg_token_length", "std_token_length",
    "avg_num_tokens",
    "email_hit_rate", "url_hit_rate", "date_hit_rate",
    "numeric_regex_hit_rate", "numeric_parse_rate", "digit_bigram_rate",
)
# ------------------------------------------------------------------------------
_LONG = 96
#: Types whose values never have more than ``_LONG`` characters as text.
_SHORT_TYPES = (
    "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date", "timestamp", "timestamp_ntz",
)
_COUNTED = ("chars", "alpha", "digit", "space", "upper", "digit_runs", "tokens", "token_squares")


def unpivot(df: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, column, value as text), one row per cell."""
    columns = columns or df.columns
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns
    ]))
    return df.select(*(keep or []), cells.alias("cell")).select(*(keep or []), "cell.*")


MEASURES = (
    "chars", "alpha", "digit", "space", "upper", "tokens", "token_chars", "token_squares",
    "digit_pairs", "pairs", "email", "url", "date", "numeric", "parse",
)


def measure(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add what the value in ``text`` contributes to the sums, null where it is null.

    All integers, so addition order cannot matter.  Characters and words are counted over
    Arrow batches; the anchored patterns end at the first character that does not fit.
    """
    v = F.col(text)
    counted = df.withColumn(f"{prefix}in", chars.counts(v, _COUNTED))
    inside = F.col(f"{prefix}in")
    columns = {
        "chars": inside["chars"], "alpha": inside["alpha"], "digit": inside["digit"], "space": inside["space"],
        "upper": inside["upper"], "tokens": inside["tokens"], "token_chars": inside["chars"] - inside["space"],
        "token_squares": inside["token_squares"],
        "digit_pairs": inside["digit"] - inside["digit_runs"],
        "pairs": inside["chars"] - 1,
        "email": v.rlike(tx.EMAIL),
        "url": v.rlike(tx.URL_SHAPE_ANY_CASE),
        "date": v.rlike(tx.DATE_SHAPE),
        "numeric": v.rlike(tx.NUMERIC),
        "parse": v.rlike(tx.FLOAT),
    }
    return counted.select(
        *df.columns,
        *[F.when(v.isNotNull(), columns[k].cast("bigint")).alias(f"{prefix}{k}") for k in MEASURES],
    )


def value_table(cells: DataFrame, all_short: bool = False) -> DataFrame:
    """Distinct (column, value) with its count ``n`` and measures; null and empty share a null key.

    ``all_short`` says that no value has over 96 characters: cells are then only counted.
    """
    value = F.when(F.col("value") != "", F.col("value"))
    keyed = cells.select("column", value.alias("value"))
    if all_short:
        distinct = keyed.groupBy("column", F.col("value").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return measure(distinct.withColumn("text", F.col("key")), "text", "").select("column", "key", "n", *MEASURES)
    is_long = F.coalesce(F.length("value") > _LONG, F.lit(False))
    keyed = keyed.select(
        "column", is_long.alias("is_long"), tx.shuffle_key(F.col("value")).alias("key"),
        F.when(is_long, F.col("value")).alias("text"),
    )
    distinct = (
        measure(keyed, "text", "m_").groupBy("column", "is_long", "key")
        .agg(F.count(F.lit(1)).alias("n"), *[F.max(f"m_{k}").alias(f"m_{k}") for k in MEASURES])
        .withColumn("text", F.when(~F.col("is_long"), F.col("key")))
    )
    return measure(distinct, "text", "s_").select(
        "column", "key", "n", *[F.coalesce(f"m_{k}", f"s_{k}").alias(k) for k in MEASURES]
    )


def table_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The value table of a table; columns whose type has short texts only are spared the search for long ones."""
    kinds = dict(df.dtypes)
    columns = columns or df.columns
    short = [c for c in columns if kinds[c].split("(")[0] in _SHORT_TYPES]
    parts = [
        value_table(unpivot(df, names), all_short)
        for names, all_short in (([c for c in columns if c not in short], False), (short, True)) if names
    ]
    return reduce(DataFrame.unionByName, parts)


def _std(squares: Column, total: Column, n: Column) -> Column:
    mean = total / n
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean))


def merge_values(tables: list[DataFrame]) -> DataFrame:
    """The value table of all rows behind the given ones: counts add up, measures belong to the value."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.groupBy("column", "key").agg(F.sum("n").alias("n"), *[F.max(k).alias(k) for k in MEASURES])


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: ``column``, ``n_rows`` and the 19 features."""
    return fingerprint_values(table_values(df, columns))


def fingerprint_values(values: DataFrame) -> DataFrame:
    """Fingerprints from a value table."""
    n, present = F.col("n"), F.col("key").isNotNull()
    sums = values.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(present, n)), F.lit(0)).alias("values"),
        F.count("key").alias("distinct"),
        F.sum(n * F.col("chars") * F.col("chars")).alias("char_squares"),
        *[F.coalesce(F.sum(n * F.col(k)), F.lit(0)).alias(k) for k in MEASURES],
    )
    c = F.col
    v, chars = c("values"), F.greatest(c("chars"), F.lit(1))

    def over(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)

    features = {
        "null_ratio": F.lit(1.0) - v / c("n_rows"),
        "cardinality_ratio": c("distinct") / v,
        "distinct_count_log": F.log1p(c("distinct")),
        "frac_alpha": c("alpha") / chars,
        "frac_digit": c("digit") / chars,
        "frac_punct": (c("chars") - c("alpha") - c("digit") - c("space")) / chars,
        "frac_space": c("space") / chars,
        "frac_upper_of_alpha": over(c("upper"), c("alpha")),
        "avg_value_length": c("chars") / v,
        "std_value_length": _std(c("char_squares"), c("chars"), v),
        "avg_token_length": over(c("token_chars"), c("tokens")),
        "std_token_length": F.when(c("tokens") == 0, F.lit(0.0)).otherwise(
            _std(c("token_squares"), c("token_chars"), c("tokens"))
        ),
        "avg_num_tokens": c("tokens") / v,
        "email_hit_rate": c("email") / v,
        "url_hit_rate": c("url") / v,
        "date_hit_rate": c("date") / v,
        "numeric_regex_hit_rate": c("numeric") / v,
        "numeric_parse_rate": c("parse") / v,
        "digit_bigram_rate": over(c("digit_pairs"), c("pairs")),
    }
    empty = v == 0
    return sums.select(
        "column", "n_rows",
        *[
            F.when(empty, F.lit(1.0 if name == "null_ratio" else 0.0))
            .otherwise(features[name]).cast("double").alias(name)
            for name in FEATURES
        ],
    )


def fingerprint_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Fingerprints of several tables under their ``source`` names."""
    parts = [
        fingerprint(df).select(F.lit(name).alias("source"), "*") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def sample_values(df: DataFrame, seq: str, columns: list[str] | None = None, n: int = 5) -> DataFrame:
    """The first ``n`` distinct non-empty values of each column: column, position, value.

    The row-number filter makes Spark keep at most ``n`` rows per column in each
    task before the window's shuffle.
    """
    columns = columns or [c for c in df.columns if c != seq]
    first_seen = (
        unpivot(df.withColumnRenamed(seq, "__s"), columns, keep=["__s"])
        .filter(F.col("value") != "")
        .groupBy("column", "value").agg(F.min("__s").alias("first_seq"))
    )
    place = F.row_number().over(Window.partitionBy("column").orderBy("first_seq", "value"))
    return first_seen.withColumn("position", place).filter(F.col("position") <= n).select(
        "column", "position", "value"
    )


def fingerprint_dataset(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Fingerprints plus up to five sample values per column, as one array."""
    prints = fingerprint_tables({k: df.drop(seq) if seq.startswith("_") else df for k, (df, seq) in tables.items()})
    samples = reduce(DataFrame.unionByName, [
        sample_values(df, seq, [c for c in df.columns if not c.startswith("_")])
        .groupBy("column").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("s"))
        .select(F.lit(name).alias("source"), "column", F.col("s.value").alias("sample_values"))
        for name, (df, seq) in tables.items()
    ])
    return prints.join(samples, ["source", "column"], "left")


def label_fingerprints(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """Fingerprints with their confirmed label; a label without a fingerprint is an error."""
    prints = pin(prints, "prints")  # read by the check and by the join
    orphan = labels.join(prints, ["source", "column"], "left_anti").limit(1).collect()
    if orphan:
        raise KeyError(f"no fingerprint for {orphan[0]['source']}.{orphan[0]['column']}")
    return prints.join(labels, ["source", "column"])
