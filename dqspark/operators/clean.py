"""Cleaning of validated records: exact duplicates, casts, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.functions import chars
from dqspark.functions import text as tx
from dqspark.operators.contract import COMPANY, SEQ, Contract

INTEGER_TEXT = r"^[+-]?[0-9]+\z"


def remove_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct content (null equals null), stamped with its first ``_seq``.

    Grouping combines copies before the shuffle, so a row repeated a billion
    times sends one record per task.
    """
    business = [c for c in df.columns if c != SEQ]
    if SEQ not in df.columns:
        return df.dropDuplicates(business)
    return df.groupBy(*business).agg(F.min(SEQ).alias(SEQ)).select(SEQ, *business)


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and removed rows, counted over pre-aggregated groups."""
    business = [c for c in df.columns if c != SEQ]
    groups = df.groupBy(*business).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kept")
    ).select("rows", "kept", (F.col("rows") - F.col("kept")).alias("removed"))


def coerce_types(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Cast columns; a value that does not fit becomes null, absent columns are skipped.

    Text goes through a pattern first: a plain cast reads ``5d`` as a double
    and trims blanks.
    """
    dtypes = dict(df.dtypes)
    casts = {}
    for name, target in schema.items():
        if name not in dtypes:
            continue
        col = F.col(f"`{name}`")
        if dtypes[name] == "string" and target in ("bigint", "int", "smallint", "tinyint"):
            col = F.when(col.rlike(INTEGER_TEXT), col)
        elif dtypes[name] == "string" and target in ("double", "float"):
            col = F.when(col.rlike(tx.FLOAT) & ~col.rlike(f"[_{tx.SPACE}]"), col)
        casts[name] = col.try_cast(target)
    return df.withColumns(casts) if casts else df


def normalize_text_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """NFKC, blanks collapsed, empty to null, in the named columns that exist."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: chars.tidy(F.col(f"`{c}`")) for c in present}) if present else df


def clean_records(valid: DataFrame, contract: Contract = COMPANY) -> DataFrame:
    """Duplicates out, integers cast, text normalized, in that order.

    Rows that differ only in blanks are therefore not merged.
    """
    integers = {f.name: "bigint" for f in contract.fields if f.kind == "int"}
    unique = remove_exact_duplicates(valid)
    return normalize_text_columns(coerce_types(unique, integers), list(contract.text_columns))


def validate_and_clean(df: DataFrame, contract: Contract = COMPANY) -> DataFrame:
    """Typed, deduplicated, normalized records of the valid rows."""
    from dqspark.operators.contract import annotate, valid_records

    return clean_records(valid_records(annotate(df, contract)), contract)
