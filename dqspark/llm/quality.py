"""Quality by compression: a text that good examples help to compress is like them.

Two zstandard dictionaries are trained, one from good and one from bad labelled text.
Every text is cut into pieces of ``PIECE`` bytes; each piece is compressed with either
dictionary, so the difference does not fade as a long text starts to help itself.  The
features are the normalised size difference (bad - good) / (bad + good), the logarithm of
the compression ratio, which tells repetition that suits either dictionary, and the
logarithm of the size.  A logistic regression fitted by Spark turns them into a probability.

The labelled rows are split by hash: dictionaries learn from one half, the calibration
from the other.  Dictionaries see at most ``max_pieces`` pieces a class, drawn by hash
from all pieces of the labelled texts (a documented bound); the calibration uses every
row of its half.  ``labels.sample`` bounds the labelled rows and weights them back.

Null texts count as empty; the empty text has a defined score as its features are (0, 0, 0).
With no labelled rows the score is 0.5; with one class only, or too few rows to calibrate,
it is the smoothed share of good rows.  Repeated rows give repeated results; duplicate and
null labels: null labels are ignored, repeats count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, pin, text_of

by_value(__name__)

PIECE = 600
DICTIONARY_BYTES = 110 * 1024
LEVEL = 3
MAX_PIECES = 4000
THRESHOLD = 0.3
FEATURES = ("difference", "ratio", "size")


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


@dataclass
class CompressionClassifier:
    """Dictionaries and calibration; ``weights`` are in the order of FEATURES."""

    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def features(self, text: Column) -> Column:
        """Array of the three features of a text column."""
        good, bad = self.good, self.bad

        @F.pandas_udf("array<double>")
        def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one, zero = compressor(good), compressor(bad)
            for batch in batches:
                rows = []
                for t in batch:
                    a = b = n = 0
                    for piece in pieces(t):
                        a += len(one.compress(piece))
                        b += len(zero.compress(piece))
                        n += len(piece)
                    rows.append([(b - a) / (a + b), math.log((a + 20) / (n + 20)), math.log1p(n)] if n else [0.0, 0.0, 0.0])
                yield pd.Series(rows)

        return measure(text)

    def score(self, text: Column) -> Column:
        """Probability of the good label."""
        logit = F.lit(float(self.intercept))
        if self.weights:
            f = self.features(text)
            logit = F.aggregate(
                F.zip_with(f, F.array(*map(F.lit, self.weights)), lambda x, w: x * w), logit, lambda a, x: a + x
            )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id`` and ``score`` of every row."""
        return docs.select(F.col(doc_id).alias("doc_id"), self.score(text_of(text)).alias("score"))


def compressor(data: bytes):
    """A compressor for one dictionary; trained dictionaries carry a header, others are plain text."""
    import zstandard

    ready = zstandard.ZstdCompressionDict(data)
    ready.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=ready, write_content_size=False, write_checksum=False)


def dictionary(samples: list[bytes]) -> bytes:
    """Trained where there is enough text, else the text itself."""
    import zstandard

    plain = b"".join(samples)[:DICTIONARY_BYTES] or b"\n" * 8
    if len(samples) < 100:
        return plain
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return plain


def fit(
    labelled: DataFrame, text: str = "text", label: str = "label", weight: str = "weight", max_pieces: int = MAX_PIECES
) -> CompressionClassifier:
    """Fit on rows of (text, label 0/1, weight)."""
    rows = pin(
        labelled.filter(F.col(label).isin(0, 1)).select(
            text_of(text).alias("text"), F.col(label).cast("int").alias("label"),
            F.col(weight).cast("double").alias("weight"), F.xxhash64(text_of(text)).alias("h"),
        ),
        "quality-labelled",
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((n_good + 0.5) / (n_bad + 0.5))
    if not (n_good and n_bad):
        return CompressionClassifier(intercept=prior)
    learn, check = rows.filter(F.pmod("h", F.lit(2)) == 0), rows.filter(F.pmod("h", F.lit(2)) == 1)
    model = CompressionClassifier(*(dictionary(sample(learn.filter(F.col("label") == k), max_pieces)) for k in (1, 0)))
    points = pin(
        check.select(model.features(F.col("text")).alias("f"), F.col("label").cast("double").alias("label"), "weight"),
        "quality-points",
    )
    seen = {r["label"] for r in points.select("label").distinct().collect()}
    if len(seen) < 2:
        return CompressionClassifier(intercept=prior)
    fitted = LogisticRegression(featuresCol="v", labelCol="label", weightCol="weight", regParam=1e-5, maxIter=100).fit(
        points.select(array_to_vector("f").alias("v"), "label", "weight")
    )
    model.weights, model.intercept = [float(w) for w in fitted.coefficients], float(fitted.intercept)
    return model


def sample(rows: DataFrame, n: int) -> list[bytes]:
    """At most ``n`` pieces out of all pieces of all rows, the lowest by hash."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        best: dict[int, bytes] = {}
        for batch in batches:
            for t in batch["text"]:
                best.update((xxhash.xxh64_intdigest(p) >> 1, p) for p in pieces(t))
            if len(best) > n:
                best = {h: best[h] for h in sorted(best)[:n]}
        best = {h: best[h] for h in sorted(best)[:n]}
        yield pd.DataFrame({"h": list(best), "piece": list(best.values())})

    found = rows.select("text").mapInPandas(cut, "h long, piece binary")
    return [bytes(r["piece"]) for r in found.orderBy("h", "piece").limit(n).collect()]
