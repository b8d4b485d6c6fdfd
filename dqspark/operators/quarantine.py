"""Quarantine model: sixteen row features plus an anomaly score into boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators import iforest
from dqspark.operators.augment import row_label
from dqspark.operators.contract import REASONS_TYPE
from dqspark.operators.coltype import balanced_weight
from dqspark.operators.metrics import average_precision, binary_metrics, clean_fpr, per_type_metrics
from dqspark.operators.ranking import stratified_split
from dqspark.operators.rowfeat import ROW_FEATURES, SHAPE_FEATURES, as_map, row_features
from dqspark.operators.zip3 import zip3_reference
from dqspark.sources.durable import pin

# --- fixed values ---------------------------------------------------------------
RULE = "quarantine_classifier"
THRESHOLD = 0.5
ROUNDS = 300
TEST_SHARE = 0.2
SEED = 42
MATRIX = (*ROW_FEATURES, "iso_forest_score")
# --------------------------------------------------------------------------------


@dataclass
class QuarantineModel:
    """Everything scoring needs; the version travels inside."""

    booster: GBTClassificationModel
    forest: DataFrame
    sample: int
    threshold: float = THRESHOLD
    version: str = "1"
    features: tuple[str, ...] = MATRIX

    def matrix(self, df: DataFrame) -> DataFrame:
        """Add the anomaly score and the feature vector, in the stored order."""
        scored = df.withColumn("iso_forest_score", iforest.anomaly_score(self.forest, SHAPE_FEATURES, self.sample))
        return VectorAssembler(inputCols=list(self.features), outputCol="__x").transform(scored)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of the bad class."""
        out = self.booster.transform(self.matrix(df))
        return out.withColumn("score", vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__y")

    def save(self, path: str) -> None:
        """Booster, forest and a metadata row under one folder."""
        self.booster.write().overwrite().save(f"{path}/booster")
        self.forest.write.mode("overwrite").parquet(f"{path}/forest")
        meta = [(self.version, self.threshold, self.sample, list(self.features))]
        self.forest.sparkSession.createDataFrame(
            meta, "version string, threshold double, sample int, features array<string>"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuarantineModel:
        meta = spark.read.parquet(f"{path}/metadata").first()
        return cls(
            GBTClassificationModel.load(f"{path}/booster"), spark.read.parquet(f"{path}/forest"),
            meta["sample"], meta["threshold"], meta["version"], tuple(meta["features"]),
        )


def fit(train: DataFrame, key: str, rounds: int = ROUNDS, trees: int = iforest.TREES, version: str = "1") -> QuarantineModel:
    """Forest on the training rows only, then class-balanced boosted trees."""
    forest = pin(iforest.fit(train, SHAPE_FEATURES, key, trees), "forest")
    sample = min(iforest.SAMPLE, train.select(key).limit(iforest.SAMPLE).count())
    shell = QuarantineModel(None, forest, sample, version=version)
    rows = balanced_weight(train.withColumn("__label", row_label(train)), "__label")
    matrix = shell.matrix(rows).select("__x", "__label", "weight")
    booster = GBTClassifier(
        featuresCol="__x", labelCol="__label", weightCol="weight", predictionCol="__y",
        maxIter=rounds, maxDepth=5, seed=SEED,
    )
    shell.booster = booster.setProbabilityCol("__p").setRawPredictionCol("__r").fit(matrix)
    return shell


def evaluate(model: QuarantineModel, test: DataFrame) -> dict:
    """PR-AUC, precision, recall, F1, clean false-positive rate and per-type metrics."""
    scored = pin(
        model.score(test).select("score", row_label(test).alias("label"), "corruption_type"), "scored"
    )
    overall = binary_metrics(scored, "score", "label", model.threshold).first()
    return {
        "pr_auc": average_precision(scored, "score", "label").first()[0],
        "precision": overall["precision"], "recall": overall["recall"], "f1": overall["f1"],
        "clean_false_positive_rate": clean_fpr(scored, "score", "corruption_type", model.threshold).first()["clean_fpr"],
        "per_type": {
            r["kind"]: r.asDict()
            for r in per_type_metrics(scored, "score", "label", "corruption_type", model.threshold).collect()
        },
    }


def train(labeled: DataFrame, key: str, rounds: int = ROUNDS, trees: int = iforest.TREES) -> tuple[QuarantineModel, dict]:
    """Split by type, fit, evaluate on the held-out fifth."""
    split = pin(stratified_split(labeled, "corruption_type", key, TEST_SHARE, SEED), "labeled")
    model = fit(split.filter(~F.col("is_test")), key, rounds, trees)
    return model, evaluate(model, split.filter("is_test"))


def score_and_route(
    df: DataFrame, model: QuarantineModel, reference: DataFrame | None = None,
    feature_rows: DataFrame | None = None, key: str = "company_id",
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, flagged rows with ``raw`` and ``reasons``).

    ``reference`` is the zip table to judge by, learned from the batch when not
    given.  ``feature_rows`` are the same rows before imputation, for a caller who
    wants them scored as they came.  ``key`` tells rows apart and must be unique.
    """
    source = df if feature_rows is None else feature_rows
    reference = zip3_reference(source) if reference is None else reference
    scored = model.score(row_features(source, reference))
    score = F.col("score")
    message = F.format_string(
        f"quarantine classifier score=%.4f, threshold={model.threshold}; the row passed the contract", score
    )
    reasons = F.array(F.struct(
        F.lit(RULE).alias("rule"), message.alias("message"), F.lit("warning").alias("severity"),
        F.lit(model.version).alias("model_version"), score.alias("score"), as_map().alias("features"),
    )).cast(REASONS_TYPE)
    flagged = score >= model.threshold
    if feature_rows is None:
        judged = scored.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("raw"), flagged.alias("__bad"), reasons.alias("reasons"))
    else:
        verdicts = scored.select(F.col(key).alias("__key"), flagged.alias("__bad"), reasons.alias("reasons"))
        judged = df.join(verdicts, df[key] == F.col("__key")).select(
            F.struct(*[df[c] for c in df.columns]).alias("raw"), "__bad", "reasons"
        )
    judged = pin(judged, "judged")
    return judged.filter(~F.col("__bad")).select("raw.*"), judged.filter("__bad").select("raw", "reasons")
