"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (letters, digits and marks, lower case) and their first four
and five letters, which stand for inflected forms.  Terms are hashed into ``SLOTS`` slots,
and all slots are inputs of the machine: none is left out for telling little alone, as two
words can tell together what neither does.  Inputs are scaled (``scales``) so that slots of
few texts, which would learn those texts by heart, move slowly.  Spark's ``FMClassifier``
learns a weight for each and a ``FACTORS``-vector whose products weigh pairs, so that an
insult next to a mention of a group can count for more than both alone.  Slots that no
labelled text holds are worth nothing.

Labels are a bounded sample per class (``labels.MAX_PER_CLASS``), weighted back through
the intercept.  Null texts count as empty; an empty text has no terms, so its score is
that of the intercept.  With one class only, the score is the smoothed share of toxic rows.
Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, pin, text_of

by_value(__name__)

#: Each slot has 1 + ``FACTORS`` dense coefficients, which every step sends to the tasks and back.
SLOTS = 1 << 16
FACTORS = 4
#: Tasks of a step; each shuffles a dense gradient.
TASKS = 5
STEPS = 120
#: Share of the labelled rows drawn for a step; the steps go through all of them some thirty times.
BATCH = 0.25
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W_]+")
_CACHED = 400_000


def terms(word: str) -> tuple[str, ...]:
    return (word, f"4{word[:4]}", f"5{word[:5]}") if len(word) > 3 else (word,)


class Slots(dict):
    """Hashed slots of the words met; it is emptied between texts when it is full."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh32_intdigest

    def __missing__(self, word: str) -> tuple[int, ...]:
        digest = self.digest
        found = self[word] = tuple([digest(t) % SLOTS for t in terms(word)])
        return found

    def of_text(self, text: str | None) -> np.ndarray:
        """The distinct slots of a text, ascending."""
        if len(self) >= _CACHED:
            self.clear()
        words = set(_WORD.findall((text or "").lower()))
        on = set(chain.from_iterable(map(self.__getitem__, words)))
        out = np.fromiter(on, np.int64, len(on))
        out.sort()
        return out


@dataclass(eq=False)
class FactorizationMachine:
    """Linear weights and factors by slot; both None if there was nothing to learn."""

    intercept: float = 0.0
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None

    def score(self, text: Column) -> Column:
        """Probability of the toxic label."""
        if self.linear is None:
            return F.lit(1.0 / (1.0 + math.exp(-self.intercept))) + F.length(text) * 0.0
        intercept, v = self.intercept, self.factors
        # one row a slot: its weight, its factors, their sum of squares
        table = np.column_stack([self.linear, v, (v**2).sum(1)])

        @F.pandas_udf("double")
        def logit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lookup = Slots()
            for batch in batches:
                sums = np.array([table.take(lookup.of_text(t), axis=0).sum(0) for t in batch]).reshape(-1, table.shape[1])
                yield pd.Series(intercept + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1]))

        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(text)))

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id`` and ``score`` of every row."""
        return docs.select(F.col(doc_id).alias("doc_id"), self.score(text_of(text)).alias("score"))


def _slot_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    lookup = Slots()
    for batch in batches:
        yield pd.Series([lookup.of_text(t).astype(np.int32) for t in batch])


def slots_of(text: Column) -> Column:
    """Slots of a text, ascending."""
    return F.pandas_udf(_slot_batches, "array<int>")(text)


def slot_counts(points: DataFrame) -> np.ndarray:
    """Documents by label (0, 1) and slot, from rows of (on, label); each task adds up its own rows first."""
    found = points.select("label", F.explode("on").alias("slot")).groupBy("slot").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("other")
    ).toPandas()
    out = np.zeros((2, SLOTS))
    out[1, found["slot"]], out[0, found["slot"]] = found["toxic"], found["other"]
    return out


def scales(counts: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Size of each slot's input: its variance to the 3/4, times 1 + its likelihood ratio to the 2/3, the largest being 1."""
    b, a = counts
    share = (a + b) / (n_toxic + n_other)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda seen, expected: np.where(seen > 0, seen * np.log(seen / expected), 0.0)
        ratio = 2 * (
            part(a, share * n_toxic) + part(b, share * n_other)
            + part(n_toxic - a, (1 - share) * n_toxic) + part(n_other - b, (1 - share) * n_other)
        )
    size = (share * (1 - share)) ** 0.75 * (1 + np.maximum(ratio, 0.0)) ** (2 / 3)
    return size / max(size.max(), 1e-300)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", weight: str = "weight") -> FactorizationMachine:
    """Fit on rows of (text, label 0/1, weight)."""
    rows = pin(
        labelled.filter(F.col(label).isin(0, 1)).select(
            slots_of(text_of(text)).alias("on"), F.col(label).cast("int").alias("label"), F.col(weight).cast("double").alias("weight")
        ),
        "toxicity-labelled",
    )
    seen = {
        r["label"]: (r["n"], r["w"])
        for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()
    }
    (n1, w1), (n0, w0) = seen.get(1, (0, 0.0)), seen.get(0, (0, 0.0))
    prior = math.log((w1 + 0.5) / (w0 + 0.5))
    if not (n1 and n0):
        return FactorizationMachine(intercept=prior)
    scale = scales(slot_counts(rows), n1, n0)

    @F.udf(VectorUDT())
    def inputs(on: list[int]) -> SparseVector:
        return SparseVector(SLOTS, on, scale[on])

    points = pin(rows.select(inputs("on").alias("v"), F.col("label").cast("double").alias("label")), "toxicity-points")
    fitted = FMClassifier(
        featuresCol="v", labelCol="label", factorSize=FACTORS, stepSize=0.1, maxIter=STEPS, regParam=1e-4,
        initStd=0.01, seed=7, tol=1e-5, miniBatchFraction=BATCH,
    ).fit(points.coalesce(TASKS))
    # classes were sampled apart: move from the sample's odds to those of all labels
    shift = prior - math.log((n1 + 0.5) / (n0 + 0.5))
    return FactorizationMachine(
        float(fitted.intercept) + shift, fitted.linear.toArray() * scale, fitted.factors.toArray() * scale[:, None]
    )
