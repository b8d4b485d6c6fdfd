"""Tables written once in the shared folder, read by several later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a fresh temporary one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.dqspark.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.dqspark.scratch.dir", folder)
    return folder.rstrip("/")


def pin(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, keeps column pruning and filter pushdown for the readers,
    and survives lost executors because the files are not on their disks.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
