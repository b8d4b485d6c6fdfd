"""Human review of model flags: queue, progress, labels, and the retraining gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.operators.quarantine import ROUNDS, RULE, SEED, TEST_SHARE
from dqspark.operators.ranking import stratified_split

# --- fixed values ---------------------------------------------------------------
DECISIONS = ("confirmed_bad", "false_positive")
PAGE = 200
MIN_REVIEWS = 20
TOLERANCE = 0.01
HUMAN_KINDS = {"confirmed_bad": "human_confirmed_bad", "false_positive": "human_false_positive"}
# --------------------------------------------------------------------------------


def ml_flag(reasons: Column) -> Column:
    """First model reason that carries features, or null."""
    return F.get(F.filter(reasons, lambda r: (r["rule"] == RULE) & r["features"].isNotNull()), F.lit(0))


def review_queue(records: DataFrame, reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """Unreviewed model flags, all of them, or the newest ``limit`` records' for a page (``PAGE``).

    A page is cut before contract failures drop out, so it may hold fewer flags.
    """
    waiting = records.join(reviews.select(F.col("record_id").alias("id")), "id", "left_anti")
    if limit is not None:
        waiting = waiting.orderBy(F.col("quarantined_at").desc(), "id").limit(limit)
    return waiting.withColumn("f", ml_flag(F.col("reasons"))).filter(F.col("f").isNotNull()).select(
        F.col("id").alias("record_id"), "raw_data", F.col("f.score").alias("score"),
        F.col("f.message").alias("message"), F.col("f.model_version").alias("model_version"),
        F.col("f.features").alias("features"), "quarantined_at",
    )


def review_progress(reviews: DataFrame) -> DataFrame:
    """One row: confirmed_bad, false_positive, total, and whether retraining is unlocked."""
    return reviews.agg(
        F.count_if(F.col("decision") == "confirmed_bad").alias("confirmed_bad"),
        F.count_if(F.col("decision") == "false_positive").alias("false_positive"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("retrain_unlocked", F.col("total") >= MIN_REVIEWS)


def reviewed_labels(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed model flags as labeled rows; features are read back as stored."""
    joined = records.join(reviews, records["id"] == reviews["record_id"]).withColumn("f", ml_flag(F.col("reasons")))
    bad = F.col("decision") == "confirmed_bad"
    return joined.filter(F.col("f").isNotNull()).select(
        "record_id",
        F.get_json_object("raw_data", "$.company_id").alias("company_id"),
        F.lit(False).alias("is_synthetic"), bad.cast("int").alias("label"),
        F.when(bad, HUMAN_KINDS["confirmed_bad"]).otherwise(HUMAN_KINDS["false_positive"]).alias("corruption_type"),
        F.col("f.features").alias("features"),
    )


def retrain_sets(synthetic: DataFrame, human: DataFrame, key: str) -> DataFrame:
    """Both sources with ``origin`` and ``is_test``; each is split on its own.

    Training takes both train parts; the gate looks at the synthetic test part
    only, the human test part is reported next to it.
    """
    parts = [
        stratified_split(df, "corruption_type", key, TEST_SHARE, SEED).withColumn("origin", F.lit(name))
        for name, df in (("synthetic", synthetic), ("human", human))
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def passes_gate(candidate: float, registered: float | None, tolerance: float = TOLERANCE) -> bool:
    """Register when nothing is registered or the candidate is at most ``tolerance`` worse."""
    return registered is None or candidate >= registered - tolerance


def retrain(synthetic: DataFrame, human: DataFrame, key: str, registered_pr_auc: float | None, rounds: int = ROUNDS) -> dict:
    """Fit on both train parts and decide on the synthetic test part.

    Both inputs carry ``key``, the sixteen feature columns, ``label`` and
    ``corruption_type``.
    """
    from dqspark.operators import quarantine
    from dqspark.operators.metrics import binary_metrics
    from dqspark.sources.durable import pin

    if human.isEmpty():
        raise ValueError("no reviewed rows to retrain on")
    rows = pin(retrain_sets(synthetic, human, key), "retrain")
    model = quarantine.fit(rows.filter(~F.col("is_test")), key, rounds)
    result = quarantine.evaluate(model, rows.filter("is_test AND origin = 'synthetic'"))
    human_test = rows.filter("is_test AND origin = 'human'")
    human_eval = None
    if not human_test.isEmpty():
        human_eval = binary_metrics(model.score(human_test), "score", "label", model.threshold).first().asDict()
    return {
        "model": model, "metrics": result, "human_eval": human_eval,
        "register": passes_gate(result["pr_auc"], registered_pr_auc),
    }
