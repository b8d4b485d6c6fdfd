"""Labelled rows to learn from: a bounded sample per class, weighted back to all labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import fold

#: At most so many labelled documents a class are learned from; the lowest by hash of the id.
MAX_PER_CLASS = 20_000


def sample(labels: DataFrame, label: str, learn: Column, doc_id: str = "doc_id", bound: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, label, weight): rows where ``learn`` holds and the label is 0 or 1.

    ``weight`` is the number of such labels a sampled row stands for.  The result has at
    most ``2 * bound`` rows of fixed width, which is what allows it to be broadcast.
    """
    rows = labels.filter(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [
        rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        .withColumn("weight", F.lit(float(max(1.0, counts.get(k, 0) / bound))))
        for k in (0, 1)
    ]
    return picked[0].unionAll(picked[1])


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int = MAX_PER_CLASS
) -> DataFrame:
    """(text, label, weight) of sampled documents outside the held-out fold."""
    picked = sample(labels, label, fold("doc_id", modulus) != held_out, bound=bound)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label", "weight")
