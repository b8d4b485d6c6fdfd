"""Fingerprints that grow with their table, stored under its name.

    <root>/<name>/values/batch=<id>/   the value table of a batch: counts and measures of distinct values
    <root>/<name>/merged=<id>/         value tables of several batches put together
    <root>/<name>/labels/              confirmed column types

A batch adds its value table; fingerprints come from the sum of all of them, so no earlier row
is read again, and the result is that of a scan over all rows.  ``compact`` replaces the
batches so far by their sum.  Long values are kept as digests with their measures.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators.fingerprint import FEATURES, fingerprint_values, label_fingerprints, merge_values, table_values
from dqspark.sources.files import _exists


class FingerprintStore:
    """Named value tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _index(self, name: str) -> str:
        return f"{self.root}/{name}/index"

    def _entries(self, name: str) -> list[dict]:
        """What has been added, in order; a merged entry stands for all before it."""
        if not _exists(self.spark, self._index(name)):
            return []
        rows = self.spark.read.parquet(self._index(name)).orderBy("place").collect()
        return [r.asDict() for r in rows]

    def _enter(self, name: str, place: int, batch: str, path: str, merged: bool) -> None:
        row = [(place, batch, path, merged)]
        self.spark.createDataFrame(row, "place bigint, batch string, path string, merged boolean").coalesce(1).write.mode("append").parquet(self._index(name))

    def add(self, name: str, df: DataFrame, batch: str | None = None, columns: list[str] | None = None) -> str:
        """Add a batch of rows.  A batch id that is there already is an error, so a repeated run counts once."""
        entries, batch = self._entries(name), batch or uuid.uuid4().hex
        if any(e["batch"] == batch for e in entries):
            raise ValueError(f"batch {batch} of {name} was added before")
        path = f"{self.root}/{name}/values/batch={uuid.uuid4().hex}"
        table_values(df, columns).write.parquet(path)
        self._enter(name, len(entries), batch, path, False)
        return batch

    def values(self, name: str) -> DataFrame:
        """The value table of all batches."""
        entries = self._entries(name)
        if not entries:
            raise KeyError(f"no fingerprints named {name}")
        start = max((i for i, e in enumerate(entries) if e["merged"]), default=0)
        return merge_values([self.spark.read.parquet(e["path"]) for e in entries[start:]])

    def compact(self, name: str) -> None:
        """Put the batches so far together, so that later reads start from one table."""
        merged = self.values(name)
        path = f"{self.root}/{name}/merged={uuid.uuid4().hex}"
        merged.write.parquet(path)
        self._enter(name, len(self._entries(name)), f"merged-{uuid.uuid4().hex}", path, True)

    def fingerprints(self, *names: str) -> DataFrame:
        """(source, column, n_rows, features) of the named tables."""
        out = None
        for name in names:
            part = fingerprint_values(self.values(name)).select(F.lit(name).alias("source"), "*")
            out = part if out is None else out.unionByName(part)
        return out

    def save_labels(self, name: str, labels: DataFrame) -> None:
        """Confirmed (column, label) of a table; every column must have a fingerprint.  A later save replaces an earlier one."""
        rows = labels.select(F.lit(name).alias("source"), "column", "label")
        label_fingerprints(self.fingerprints(name), rows)
        saves = self.spark.read.parquet(f"{self.root}/{name}/labels").agg(F.max("save")).first()[0] if _exists(
            self.spark, f"{self.root}/{name}/labels") else 0
        rows.withColumn("save", F.lit(saves + 1)).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/labels")

    def labeled(self, *names: str) -> DataFrame:
        """Stored fingerprints with their confirmed labels: what a column-type model learns from."""
        out = None
        for name in names:
            saved = self.spark.read.parquet(f"{self.root}/{name}/labels")
            labels = saved.filter(F.col("save") == saved.agg(F.max("save")).scalar()).drop("save")
            part = label_fingerprints(self.fingerprints(name), labels)
            out = part if out is None else out.unionByName(part)
        return out.select("source", "column", "n_rows", *FEATURES, "label")
