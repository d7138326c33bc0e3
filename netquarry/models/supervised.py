"""Boosted trees and logistic regression over a detector's inputs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import markov
from .base import INPUTS, TRAINED, features, untrained

BACKENDS = ("logistic", "boosted")


class Supervised:
    """raw_score is the chance of label 1. Labels are 0 and 1; a new fit replaces the old one."""

    def __init__(self, threat_class: str, backend: str = "boosted", depth: int = 4, rounds: int = 20):
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend {backend!r}; known are {', '.join(BACKENDS)}")
        self.threat_class, self.backend, self.depth, self.rounds = threat_class, backend, depth, rounds
        self.model: PipelineModel | None = None

    def fit(self, rows: DataFrame, label: str = "label") -> Supervised:
        ready = features(rows.where(F.col(label).isin(0, 1)), self.threat_class).withColumn("label", F.col(label).cast("double"))
        stages = [VectorAssembler(inputCols=list(INPUTS[self.threat_class]), outputCol="inputs")]
        if self.backend == "logistic":
            n = max(1, ready.count())
            stages += [StandardScaler(inputCol="inputs", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", regParam=1.0 / n)]
        else:
            stages.append(GBTClassifier(featuresCol="inputs", maxDepth=self.depth, maxIter=self.rounds, seed=7))
        new = Supervised(self.threat_class, self.backend, self.depth, self.rounds)
        new.model = Pipeline(stages=stages).fit(ready)
        return new

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return untrained(rows)
        done = self.model.transform(features(rows, self.threat_class))
        one = vector_to_array("probability")[1]
        return done.withColumns({"raw_score": one, "status": F.lit(TRAINED)}).drop("inputs", "scaled", "rawPrediction", "probability", "prediction")


def dga_cascade(rows: DataFrame, gate_threshold: float | None, classifier: Supervised) -> DataFrame:
    """Rows whose Markov score reaches the gate are benign without the classifier; only the others are scored by it."""
    gated = markov.gate(F.col("markov_score"), gate_threshold)
    passed = rows.where(gated).withColumns({"raw_score": F.lit(0.0), "status": F.lit("gated_benign")})
    return passed.unionByName(classifier.score(rows.where(~gated)).select(*passed.columns))
