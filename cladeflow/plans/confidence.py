"""Confidence of predictions: a weighted logistic regression per rank, and a random-forest check of outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from cladeflow.operators import aggregate, evaluate


def confidence_features(df: DataFrame, maxprob: str = "maxprob") -> DataFrame:
    """Adds the two greatest probabilities and their difference; a missing second one is 0."""
    p1, p2 = F.get(maxprob, F.lit(0)), F.coalesce(F.get(maxprob, F.lit(1)), F.lit(0.0))
    return df.withColumn("p1", p1).withColumn("p2", p2).withColumn("margin", p1 - p2)


def fit_confidence(df: DataFrame, features: Sequence[str], label: str, max_iter: int = 50) -> PipelineModel:
    """Model of `label` (was the prediction right?) on standardised features, both classes weighing the same."""
    inputs = [*features, "p1", "p2", "margin"]
    weighted = df.join(evaluate.class_weights(df, label), label)
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="weight", maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(weighted)


def apply_confidence(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds `confidence`."""
    scored = model.transform(df).withColumn("confidence", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.drop("_raw", "_scaled", "rawPrediction", "probability", "prediction")


def confidence_metrics(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """`auc, aupr, pos_rate, tn, fp, fn, tp` of the confidence at a threshold of one half."""
    said = F.col("confidence") > 0.5
    right = F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        *[
            F.sum((a & b).cast("int")).alias(name)
            for name, a, b in (("tn", ~said, ~right), ("fp", said, ~right), ("fn", ~said, right), ("tp", said, right))
        ],
        F.avg(label).alias("pos_rate"),
    )
    areas = (evaluate.roc_auc(df, label, "confidence", keys), evaluate.pr_auc(df, label, "confidence", keys))
    if keys:
        return counts.join(areas[0], list(keys)).join(areas[1], list(keys))
    return counts.withColumn("auc", areas[0].scalar()).withColumn("aupr", areas[1].scalar())


def rf_report(train: DataFrame, test: DataFrame, vec: str, label: str, key: str, trees: int = 30, seed: int = 0) -> DataFrame:
    """Classification reports of a forest on window outputs: `kind, class, precision, …` for windows, mean, median, vote.

    It is fitted on the windows of one split and judged on the windows and the sequence aggregates of the other.
    """

    def features(df):
        return df.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))

    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, seed=seed)
    model = forest.fit(features(train))
    windows = model.transform(features(test)).withColumn("pred", F.col("prediction").cast("int"))
    labels = aggregate.pick_label(test, key, label)
    means = aggregate.mean_outputs(test, [key], vec).join(labels, key)
    medians = aggregate.median_outputs(test, [key], vec).groupBy(key).agg(
        # One row per class of a sequence: the vector is as wide as the class list.
        F.transform(F.array_sort(F.collect_list(F.struct("class", "median"))), lambda s: s.median).alias(vec)
    )
    ballots = windows.groupBy(key, "pred").agg(F.count(F.lit(1)).alias("_n"))
    votes = ballots.groupBy(key).agg(F.max_by("pred", F.struct(F.col("_n"), -F.col("pred"))).alias("pred"))
    kinds = {
        "window": windows,
        "mean": model.transform(features(means)).withColumn("pred", F.col("prediction").cast("int")),
        "median": model.transform(features(medians.join(labels, key))).withColumn("pred", F.col("prediction").cast("int")),
        "vote": votes.join(labels, key),
    }
    out = None
    for kind, rows in kinds.items():
        report = evaluate.classification_report(rows, label, "pred").withColumn("kind", F.lit(kind))
        out = report if out is None else out.unionByName(report)
    return out
