"""What several of these operators share: words, keys and written steps."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.sources.durable import pin

__all__ = ["by_value", "GAP", "pin", "table", "words", "lower_ascii", "fold", "text_of", "likely_in"]

#: White space as all operators see it: space, tab, line feed, vertical tab, form feed, return.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_value(module: str) -> None:
    """Functions of the module travel inside the tasks, so workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs without white space; an empty array for an empty text."""
    inner = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


#: Bits of the table behind ``likely_in``: a megabyte, in rows of 4 kB.
BITS, ROW_BITS = 1 << 23, 1 << 15


def likely_in(rows: DataFrame, key: Column, members: DataFrame, member: str) -> DataFrame:
    """Rows whose 64-bit key is among the members, and a few others: a filter ahead of a join.

    The members' hashes set bits of a table of fixed size, which is broadcast.  With very
    many members more rows pass, at worst all of them; none of the members' rows is lost.
    """
    place = F.pmod(F.col(member), F.lit(BITS).cast("bigint"))
    marks = members.select(F.floor(place / ROW_BITS).cast("int").alias("_slot"), (place % ROW_BITS).alias("_bit"))
    table = marks.groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    own = F.pmod(key, F.lit(BITS).cast("bigint"))
    asked = rows.withColumns({"_slot": F.floor(own / ROW_BITS).cast("int"), "_bit": (own % ROW_BITS).cast("int")})
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("_bit") % 8 + 1)
    return asked.join(F.broadcast(table), "_slot").filter(byte.bitwiseAND(mask) > 0).select(*rows.columns)


def fold(doc_id: str, modulus: int) -> Column:
    """CRC-32 of the id written as text, modulo ``modulus``; 0 for a null id."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
