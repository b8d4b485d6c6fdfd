"""Semantic column types: a class-balanced random forest over fingerprints."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.operators.fingerprint import FEATURES, fingerprint
from dqspark.operators.lookup import look_up
from dqspark.operators.metrics import macro_f1
from dqspark.operators.ranking import stratified_split

TREES = 300


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    weights = counts.select(
        label,
        (F.sum("__n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("__n"))).alias("weight"),
    )
    return look_up(df, weights, label, "inner")


def train(labeled: DataFrame, trees: int = TREES, seed: int = 42) -> PipelineModel:
    """Fit on rows with the 19 features and ``label``."""
    stages = [
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=list(FEATURES), outputCol="vector"),
        RandomForestClassifier(
            labelCol="label_index", featuresCol="vector", weightCol="weight",
            numTrees=trees, maxDepth=10, featureSubsetStrategy="sqrt", seed=seed,
        ),
    ]
    return Pipeline(stages=stages).fit(balanced_weight(labeled, "label"))


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labelsArray[0])


def predict(model: PipelineModel, prints: DataFrame) -> DataFrame:
    """column, predicted_type, confidence and the whole distribution."""
    labels = labels_of(model)
    keep = [c for c in ("source", "column", "label") if c in prints.columns]
    scored = prints
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    shares = F.slice(vector_to_array("probability"), 1, len(labels))
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_max("shares")
    return (
        scored.select(*keep, shares.alias("shares"))
        .select(
            *keep,
            F.element_at(names, F.array_position("shares", best).cast("int")).alias("predicted_type"),
            best.alias("confidence"),
            F.map_from_arrays(names, "shares").alias("proba"),
        )
    )


def classify(model: PipelineModel, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Predicted type of every column of a table."""
    return predict(model, fingerprint(df, columns))


def evaluate(labeled: DataFrame, key: str = "key", trees: int = TREES, seed: int = 42):
    """(model, held-out predictions, macro-F1 row) with a min-1 stratified quarter held out."""
    split = stratified_split(labeled, "label", key, 0.25, seed)
    model = train(split.filter(~F.col("is_test")), trees, seed)
    held_out = predict(model, split.filter("is_test"))
    return model, held_out, macro_f1(held_out, "label", "predicted_type")
