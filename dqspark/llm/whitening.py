"""Whitening of embeddings from a covariance found by polarisation.

Every entry c of a vector becomes the integer x = floor(64 c) + 1000000.  The fit list holds
each distinct x-vector once.  Two passes over it give, all in exact integers,

1. n and the sum S of every dimension, and from these the whole number m nearest to each mean;
2. the sum of squares Q of the centred values u = x - m, for every dimension i and for the sum
   u_i + u_j of every pair of dimensions.

Centred on the very mean a sum of squares is P = Q - (sum of u)^2 / n, so the differences of
variances (P of the pair - P of i - P of j) / 2 are the cross products of all pairs.  They are
divided by n as fractions, rounded once to doubles and assembled for ``eigh``.  Tasks send one
row a sum; the driver holds d (d + 1) / 2 numbers for d dimensions, whatever the number of rows.
A third pass over the fit list measures the covariance of the whitened values.

Rows that cannot be used are left out: a null vector, one with a null, NaN or infinite entry or
an entry beyond 2^55, whose x would not fit 64 bits, the empty vector, and vectors of another length than the commonest
(ties: the longest).  Null ids stay, repeated rows each get their result, further columns are
ignored.  A component has variance if its eigenvalue is above ``RELATIVE`` of the largest;
others (one vector only, fewer vectors than dimensions, constant dimensions) are listed with a
null ``whitened``, and ``identity_error`` is over those that have variance (0 if none has).
``explained`` is 0 where the trace is 0.  ``deviation`` is null where it exceeds 64 bits.
An empty table gives an empty result.  Vectors with equal x have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value, pin

by_value(__name__)

STEP, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues up to this share of the largest are rounding, not variance.
RELATIVE = 1e-11
_LARGEST = float(2**61)
_ROWS = 4096


def usable(vector: Column) -> Column:
    """Whether every entry of a double array can become an integer; null for a null vector."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * STEP > _LARGEST))
    return (F.size(vector) > 0) & ~bad


def integers(vector: Column) -> Column:
    """x of every entry of a double array."""
    return F.transform(vector, lambda c: F.floor(c * STEP).cast("bigint") + F.lit(OFFSET).cast("bigint"))


def matrices(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """The x-vectors of a batch as integer matrices of few rows."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for at in range(0, len(flat), _ROWS):
        yield flat[at : at + _ROWS]


def roomy(values: np.ndarray, bound: int) -> np.ndarray:
    """64-bit integers while ``bound`` fits them, else integers of any size."""
    return values if bound < 2**62 else values.astype(object)


def rows_of(pairs: list[tuple[str, int]]) -> pa.RecordBatch:
    """Keys and whole numbers of any size, cut in two so that sums of them fit 38 digits."""
    keys, values = zip(*pairs, strict=True)
    parts = [divmod(v, _CUT) for v in values]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), *(pa.array([Decimal(p[i]) for p in parts], pa.decimal128(38, 0)) for i in (0, 1))], ["key", "upper", "lower"])


def added(parts: DataFrame) -> dict[str, int]:
    """Totals of the tasks' rows by key."""
    found = parts.groupBy("key").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).toArrow()
    return {r["key"]: int(r["upper"]) * _CUT + int(r["lower"]) for r in found.to_pylist()}


_CUT = 10**18
_SUMS = "key string, upper decimal(38,0), lower decimal(38,0)"


def sums(fit_list: DataFrame, d: int) -> tuple[int, list[int], int]:
    """n, the exact sum of every dimension, and the largest |x|."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, dtype=object)
        for batch in batches:
            for x in matrices(batch, d):
                total = total + roomy(x, int(np.abs(x).max()) * len(x)).sum(0).astype(object)
        yield rows_of([(str(i), int(v)) for i, v in enumerate(total)])

    size = fit_list.agg(F.count("x").alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    if not size["n"]:
        return 0, [], 0
    got = added(fit_list.select("x").mapInArrow(add, _SUMS))
    return size["n"], [got[str(i)] for i in range(d)], max(abs(size["low"]), abs(size["high"]))


def polarised(fit_list: DataFrame, middle: list[int]) -> dict[str, int]:
    """Sum of squares of every centred dimension ("i") and of every sum of two ("i+j")."""
    d, centre = len(middle), np.array(middle, dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pair = [0] * d, [np.zeros(d - i - 1, dtype=object) for i in range(d)]
        for batch in batches:
            for x in matrices(batch, d):
                u = x - centre
                u = roomy(u, 4 * int(np.abs(u).max()) ** 2 * len(u))
                for i in range(d):
                    own[i] += int((u[:, i] * u[:, i]).sum())
                    both = u[:, i : i + 1] + u[:, i + 1 :]
                    pair[i] = pair[i] + (both * both).sum(0).astype(object)
        yield rows_of([(str(i), own[i]) for i in range(d)]
                      + [(f"{i}+{j}", int(v)) for i in range(d) for j, v in enumerate(pair[i], i + 1)])

    return added(fit_list.select("x").mapInArrow(add, _SUMS))


def covariance(n: int, totals: list[int], middle: list[int], squares: dict[str, int]) -> np.ndarray:
    """Differences of variances, exact until the last rounding."""
    d = len(totals)
    rest = [s - n * m for s, m in zip(totals, middle, strict=True)]
    own = [Fraction(squares[str(i)]) - Fraction(rest[i] ** 2, n) for i in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = float(own[i] / n)
        for j in range(i + 1, d):
            both = Fraction(squares[f"{i}+{j}"]) - Fraction((rest[i] + rest[j]) ** 2, n)
            out[i, j] = out[j, i] = float((both - own[i] - own[j]) / (2 * n))
    return out


@dataclass(eq=False)
class Whitening:
    """Components by falling eigenvalue; ``width`` is the number of dimensions."""

    n: int
    totals: list[int]
    middle: list[int]
    high: int
    components: np.ndarray  # one a row
    eigenvalues: np.ndarray
    explained: list[float]
    with_variance: int
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.totals)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer vectors, for the components with variance."""
        rest = np.array([float(Fraction(s, self.n) - m) for s, m in zip(self.totals, self.middle, strict=True)])
        k = self.with_variance
        centred = (x - np.array(self.middle, dtype=np.int64)).astype(float) - rest
        return centred @ (self.components[:k] / np.sqrt(self.eigenvalues[:k])[:, None]).T

    def apply(self, rows: DataFrame, keep: str = "vec_id") -> DataFrame:
        """``keep``, ``deviation`` and the array ``whitened`` of rows with an x-vector."""
        model, d = self, self.width
        kind = rows.schema[keep].dataType.simpleString()
        bound = self.n * self.high + max((abs(s) for s in self.totals), default=0)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.array(model.totals, dtype=object)
            for batch in batches:
                far, white = [], []
                for x in matrices(batch, d):
                    apart = roomy(x, bound) * model.n - (sums if bound >= 2**62 else sums.astype(np.int64))
                    most = int(np.abs(apart).max())
                    apart = roomy(apart, most * most * d)
                    far += [int(v) if v < 2**63 else None for v in (apart * apart).sum(1)]
                    white += [[*map(float, w)] for w in model.project(x)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(keep), pa.array(far, pa.int64()), pa.array(white, pa.list_(pa.float64()))],
                    [keep, "deviation", "whitened"])

        return rows.select(keep, "x").mapInArrow(measure, f"`{keep}` {kind}, deviation bigint, whitened array<double>")


def measured_error(model: Whitening, fit_list: DataFrame) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k, d = model.with_variance, model.width
    if not k:
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in matrices(batch, d):
                w = model.project(x)
                first, second = first + w.sum(0), second + w.T @ w
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    found = fit_list.select("x").mapInArrow(add, "place bigint, value double")
    got = {r["place"]: r["total"] for r in found.groupBy("place").agg(F.sum("value").alias("total")).collect()}
    values = np.array([got[i] for i in range(k + k * k)]) / model.n
    mean, second = values[:k], values[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def vectors(rows: DataFrame, embedding: str, keep: str = "vec_id") -> tuple[DataFrame, int]:
    """Usable rows as (keep, x) and the number of dimensions."""
    read = rows.select(F.col(keep), F.col(embedding).cast("array<double>").alias("_v"))
    lengths = read.filter(usable(F.col("_v"))).groupBy(F.size("_v").alias("d")).count()
    best = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    d = best["d"] if best else 0
    fine = read.filter((F.size("_v") == d) & usable(F.col("_v")))
    return fine.select(keep, integers(F.col("_v")).alias("x")), d


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct x-vectors of the rows; None if there are none."""
    fit_list = pin(rows.select("x").distinct(), "whitening-fit")
    n, totals, high = sums(fit_list, d)
    if not n:
        return None
    middle = [(2 * s + n) // (2 * n) for s in totals]
    v = covariance(n, totals, middle, polarised(fit_list, middle))
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, trace = values[order], float(np.trace(v))
    live = int((values > RELATIVE * values[0]).sum()) if values[0] > 0 else 0
    shares = [max(float(e), 0.0) / trace if trace > 0 else 0.0 for e in values]
    model = Whitening(n, totals, middle, high, columns.T[order], values, shares, live)
    model.identity_error = measured_error(model, fit_list)
    return model


def whiten(rows: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: see the module's text."""
    kind = rows.schema[vec_id].dataType.simpleString()
    fine, d = vectors(rows, embedding, vec_id)
    model = fit(fine, d, components) if d else None
    if model is None:
        return rows.sparkSession.createDataFrame(
            [], f"`{vec_id}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    done = model.apply(fine, vec_id).withColumn(
        "c", F.explode(F.array(*[
            F.struct(F.lit(i + 1).alias("component"), F.lit(e).alias("explained")) for i, e in enumerate(model.explained)])))
    return done.select(
        vec_id, F.col("c.component").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        F.get("whitened", F.col("c.component") - 1).alias("whitened"), F.col("c.explained").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
