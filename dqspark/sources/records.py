"""CSV records that run over line breaks, read by many tasks.

A quoted field may hold line breaks, so a line is not always a record, and a task that starts
in the middle of a file cannot tell whether it starts inside quotes.  Each task therefore
follows its lines twice, as if they began outside and as if they began inside a quoted field,
and reports where it ends for either.  One row a block of a file comes back; following them in
order tells where every block really begins.  A second pass cuts the blocks into records.  The
piece of a record at the end of a block and its rest at the begin of later ones are the only
rows that move; they meet in one group a record.

A quote opens a field only at the field's begin; inside, two quotes are one character.
"""

from __future__ import annotations

import bisect
import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dqspark.functions.travel import by_value
from dqspark.sources.durable import pin

by_value(__name__)

_QUOTED = re.compile(r'(?:[^"]|"")*+"')


def stays_open(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a quoted field is open behind the line, if one was (``inside``) before it."""
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            at, inside = at + 1, True
        if inside:
            closed = _QUOTED.match(line, at)
            if closed is None:
                return True
            at, inside = closed.end(), False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): lines in the order of ``place`` within a block of a file."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")


def follow(lines: DataFrame) -> DataFrame:
    """(file, block, from_outside, from_inside, crossed) of every block with a quote in it.

    The first two tell whether a field is open at its end for either begin; ``crossed`` whether
    a line ends inside quotes although the block began outside.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = state.setdefault((file, block), [False, True, False])
                own[0], own[1] = stays_open(line, own[0]), stays_open(line, own[1])
                own[2] |= own[0]
        rows = [(*k, *v) for k, v in state.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "from_outside", "from_inside", "crossed"])

    quoted = lines.filter(F.contains("value", F.lit('"'))).select("file", "block", "value")
    found = quoted.mapInArrow(walk, "file string, block bigint, from_outside boolean, from_inside boolean, crossed boolean")
    return found


def changes(blocks: DataFrame) -> DataFrame:
    """(file, block, inside) of followed blocks behind which the state is another than before them.

    A block fixes the state, swaps it or leaves it: behind a block it is what the last fixing
    one said, turned by the number of swaps since.
    """
    so_far = Window.partitionBy("file").orderBy("block")
    swaps = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(so_far)
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").alias("said"), F.col("swaps").alias("at")))
    marked = blocks.withColumn("swaps", swaps).withColumn("fixed", F.last(fixed, ignorenulls=True).over(so_far))
    turned = (F.col("swaps") - F.coalesce("fixed.at", F.lit(0))) % 2 == 1
    ends = marked.select("file", "block", (F.coalesce("fixed.said", F.lit(False)) != turned).alias("inside"))
    before = F.coalesce(F.lag("inside").over(so_far), F.lit(False))
    return ends.withColumn("before", before).filter("inside <> before").select("file", "block", "inside")


def pieces(lines: DataFrame, turns: dict[str, list[int]]) -> DataFrame:
    """(file, block, place, text, head, tail) of records and parts of records.

    ``head``: it goes on from an earlier block; ``tail``: it goes on in a later one.  A block
    wholly inside a field is one piece that is both.  ``turns`` lists the blocks of a file behind
    which the state has changed, ascending: it is inside after an odd number of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, head, first = None, [], False, False, 0

        def piece(tail: bool) -> tuple:
            return (*now, first, "\n".join(held), head, tail)

        for batch in batches:
            out = []
            for file, block, place, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != now:
                    if held:
                        out.append(piece(True))
                    now, held = (file, block), []
                    inside = head = bisect.bisect_left(turns.get(file, []), block) % 2 == 1
                if not held:
                    first = place
                held.append(line)
                inside = stays_open(line, inside) if '"' in line else inside
                if not inside:
                    out.append(piece(False))
                    held, head = [], False
            yield as_batch(out)
        if held:
            yield as_batch([piece(True)])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "place", "text", "head", "tail"])

    return lines.mapInArrow(cut, "file string, block bigint, place bigint, text string, head boolean, tail boolean")


def joined(parts: DataFrame) -> DataFrame:
    """(file, block, place, text) of whole records; parts of one record are put together."""
    whole = parts.filter(~F.col("head") & ~F.col("tail")).select("file", "block", "place", "text")
    broken = parts.filter(F.col("head") | F.col("tail"))
    by_place = Window.partitionBy("file").orderBy("block", "place")
    starts = broken.withColumn("record", F.sum((~F.col("head")).cast("int")).over(by_place))
    rest = starts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(rest)


def crossing_files(lines: DataFrame) -> dict[str, list[int]]:
    """Files in which a record runs over a line break, with the blocks that change the state."""
    blocks = pin(follow(lines), "quotes")
    files = {r["file"]: [] for r in blocks.filter("crossed").select("file").distinct().collect()}
    if files:
        for r in changes(blocks).filter(F.col("file").isin(*files)).orderBy("file", "block").collect():
            files[r["file"]].append(r["block"])
    return files


def csv_records(lines: DataFrame, turns: dict[str, list[int]]) -> DataFrame:
    """(file, block, place, text) of all records, without blank ones."""
    records = joined(pieces(lines.select("file", "block", "place", "value"), turns))
    return records.withColumn("text", F.regexp_replace("text", r"\r\z", "")).filter(F.col("text") != "")


def header_names(line: str) -> list[str]:
    """Column names of a header record: ``_c<i>`` for an empty one, repeated ones get their number."""
    names = next(csv.reader([line], strict=False))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string, an empty cell null, in the order of the files.

    If no record of any file runs over a line break, this is Spark's own reader; otherwise
    records are put together first and each is read by ``from_csv``.
    """
    lines = lines_of(spark, path)
    turns = crossing_files(lines)
    if not turns:
        return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')
    records = pin(csv_records(lines, turns).orderBy("file", "block", "place"), "records")
    first = records.groupBy("file").agg(F.min_by(F.struct("text", "block", "place"), F.struct("block", "place")).alias("h"))
    firsts = pin(first.select("file", "h.*"), "headers")
    head = firsts.orderBy("file").first()["text"].removeprefix("\ufeff")
    body = records.join(F.broadcast(firsts.select("file", "block", "place")), ["file", "block", "place"], "left_anti")
    names = ", ".join(f"`{n.replace('`', '``')}` string" for n in header_names(head))
    parsed = F.from_csv("text", names, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return body.select(parsed.alias("r")).select("r.*")
