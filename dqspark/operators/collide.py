"""Colliding names and repeated texts: grouped counts, no pair comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions import text as tx

# --- fixed values ---------------------------------------------------------------
LEGAL_FORMS = (
    "inc", "incorporated", "llc", "llp", "ltd", "limited", "corp", "corporation", "co", "company",
    "plc", "gmbh", "ag", "sa", "group", "holding", "holdings", "international",
)
# --------------------------------------------------------------------------------
NAME_TAIL = rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+\z"
NOT_WORD = r"[^\p{L}\p{Nd} ]+"


def bare_name(name: Column) -> Column:
    """Lower case, punctuation out, blanks collapsed, trailing legal forms dropped."""
    flat = tx.collapse(F.regexp_replace(tx.collapse(F.lower(name)), NOT_WORD, ""))
    return F.regexp_replace(flat, NAME_TAIL, "")


def name_collisions(df: DataFrame, name: str, key: str) -> DataFrame:
    """Bare names carried by more than one key: name, keys, rows."""
    named = df.filter(F.col(name).isNotNull()).select(bare_name(F.col(name)).alias("bare_name"), F.col(key).alias("k"))
    # one row per (name, key) first, so a placeholder name is counted from many tasks
    pairs = named.groupBy("bare_name", "k").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("bare_name").agg(
        F.count("k").alias("keys"), F.sum("n").alias("rows")
    ).filter((F.col("keys") > 1) & (F.col("bare_name") != ""))


def repeat_groups(df: DataFrame, owner: str, text: str) -> DataFrame:
    """One row: groups of equal (owner, text) with two or more rows, their rows, share of all rows.

    Long texts are grouped by digest.
    """
    known = df.filter(F.col(owner).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(owner, tx.shuffle_key(F.col(text)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("n") > 1
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(repeated).alias("groups"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("group_rows"),
    ).withColumn("share", F.when(F.col("rows") > 0, F.col("group_rows") / F.col("rows")))


def repeat_by_location(df: DataFrame, owner: str, text: str, location: str) -> DataFrame:
    """Repeat groups split by one or several locations: bucket, groups, rows, share of repeated rows."""
    known = df.filter(F.col(owner).isNotNull() & F.col(text).isNotNull())
    per_place = known.groupBy(owner, tx.shuffle_key(F.col(text)).alias("t"), location).agg(F.count(F.lit(1)).alias("n"))
    groups = per_place.groupBy(owner, "t").agg(F.sum("n").alias("n"), F.count(location).alias("places")).filter(F.col("n") > 1)
    bucket = F.when(F.col("places") > 1, "several locations").otherwise("one location")
    out = groups.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))
    total = out.agg(F.sum("rows")).scalar()
    return out.withColumn("share", F.col("rows") / total)


def name_variance(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row: keys, keys with several spellings, the largest number of spellings."""
    pairs = df.filter(F.col(key).isNotNull() & F.col(name).isNotNull()).select(key, name).distinct()
    per_key = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("spellings"))
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("spellings") > 1).alias("varying_keys"),
        F.coalesce(F.max("spellings"), F.lit(0)).alias("max_spellings"),
    )


def id_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """One row: distinct ids on both sides, only left, only right."""
    a = left.filter(F.col(left_key).isNotNull()).select(F.col(left_key).alias("id"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.filter(F.col(right_key).isNotNull()).select(F.col(right_key).alias("id"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("common"),
        F.count_if(F.col("r") == 0).alias("left_only"),
        F.count_if(F.col("l") == 0).alias("right_only"),
    )


def repeat_same_day(df: DataFrame, owner: str, text: str, stamp: str) -> DataFrame:
    """One row: repeat groups, those within one day (24 h), their share, days spanned by the table."""
    groups = df.filter(F.col(owner).isNotNull() & F.col(text).isNotNull()).groupBy(
        owner, tx.shuffle_key(F.col(text)).alias("t")
    ).agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("lo"), F.max(stamp).alias("hi"))
    repeated = F.col("n") > 1
    within = repeated & (F.col("hi") <= F.col("lo") + F.expr("INTERVAL 1 DAY"))
    return groups.agg(
        F.count_if(repeated).alias("groups"), F.count_if(within).alias("same_day_groups"),
        F.date_diff(F.max("hi"), F.min("lo")).cast("bigint").alias("span_days"),
    ).withColumn("share", F.when(F.col("groups") > 0, F.col("same_day_groups") / F.col("groups")))
