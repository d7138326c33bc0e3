"""Precision-recall curves, per-class thresholds, isotonic calibration and canary comparison.

Input: threat_class, y (0 or 1), score. A class's rows are first counted by distinct score, so what is sorted in one
task is its distinct scores, not its rows.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASS = "threat_class"
#: Objectives of the medium tier by class; no threshold is set before one has been fitted.
OBJECTIVES = (
    ("ddos", "f_beta", 2.0, None),
    ("c2_beaconing", "f_beta_or_min_precision", 2.0, 0.90),
    ("dga", "min_precision", None, 0.90),
    ("encrypted_malware", "f_beta", 2.0, None),
    ("port_scanning", "min_precision", None, 0.95),
    ("exfiltration", "f1", None, None),
)
KNOWN = ("f_beta", "min_precision", "f1", "f_beta_or_min_precision")
HIGH_PRECISION = 0.95


def pr_curve(scored: DataFrame) -> DataFrame:
    """threat_class, threshold, tp, fp, precision, recall at every distinct score. Without positives recall is 1."""
    points = scored.groupBy(CLASS, "score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy(CLASS).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(CLASS)
    curve = points.select(CLASS, F.col("score").alias("threshold"), F.sum("p").over(down).alias("tp"), (F.sum("n").over(down) - F.sum("p").over(down)).alias("fp"), F.sum("p").over(whole).alias("positives"))
    recall = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(1.0)
    return curve.select(CLASS, "threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"), "positives")


def with_gain(curve: DataFrame) -> DataFrame:
    """Adds each point's part of the average precision: the gain of recall times the precision; 0 without positives."""
    before = F.coalesce(F.lag("recall").over(Window.partitionBy(CLASS).orderBy(F.desc("threshold"))), F.lit(0.0))
    return curve.withColumn("gain", F.when(F.col("positives") > 0, (F.col("recall") - before) * F.col("precision")).otherwise(0.0))


def average_precision(scored: DataFrame) -> DataFrame:
    """The step-wise sum, not the area of a trapezoid."""
    return with_gain(pr_curve(scored)).groupBy(CLASS).agg(F.sum("gain").alias("average_precision"))


def f_beta(beta: Column) -> Column:
    p, r = F.col("precision"), F.col("recall")
    return (1 + beta * beta) * (p * r) / (beta * beta * p + r + F.lit(1e-12))


def _best(value: Column, where: Column) -> Column:
    """(threshold, precision, recall) of the largest value; of equal ones the lowest threshold."""
    point = F.struct("threshold", "precision", "recall")
    return F.max_by(F.when(where, point), F.when(where, F.struct(value.alias("v"), (-F.col("threshold")).alias("t"))))


def best_f_beta(curve: DataFrame, beta: float) -> DataFrame:
    return curve.groupBy(CLASS).agg(_best(f_beta(F.lit(beta)), F.lit(True)).alias("x")).select(CLASS, "x.*")


def best_min_precision(curve: DataFrame, least: float) -> DataFrame:
    """The point of largest recall whose precision reaches ``least``; nulls if none does."""
    return curve.groupBy(CLASS).agg(_best(F.col("recall"), F.col("precision") >= least).alias("x")).select(CLASS, "x.*")


def objectives(spark: SparkSession, rows=OBJECTIVES) -> DataFrame:
    for _, objective, _, _ in rows:
        if objective not in KNOWN:
            raise ValueError(f"unknown objective {objective!r}; known are {', '.join(KNOWN)}")
    return spark.createDataFrame(list(rows), "threat_class string, objective string, beta double, min_precision double")


def class_thresholds(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """High and medium tier of every class, with precision and recall there, and average precision, in one pass per class."""
    curve = with_gain(pr_curve(scored)).join(wanted, CLASS)
    kind = F.col("objective")
    beta = F.when(kind == "f1", 1.0).when(kind == "f_beta", F.coalesce("beta", F.lit(1.0))).otherwise(F.coalesce("beta", F.lit(2.0)))
    by_precision = _best(F.col("recall"), F.col("precision") >= F.coalesce("min_precision", F.lit(0.9)))
    by_f = _best(f_beta(beta), F.lit(True))
    tiers = curve.groupBy(CLASS, "objective").agg(_best(F.col("recall"), F.col("precision") >= HIGH_PRECISION).alias("high"), by_precision.alias("p"), by_f.alias("f"), F.sum("gain").alias("average_precision"))
    medium = F.when(kind == "min_precision", F.col("p")).when(kind == "f_beta_or_min_precision", F.coalesce("p", "f")).otherwise(F.col("f"))
    return tiers.withColumn("medium", medium).select(
        CLASS, F.col("high.threshold").alias("high_threshold"), F.col("high.precision").alias("high_precision"), F.col("high.recall").alias("high_recall"),
        F.col("medium.threshold").alias("medium_threshold"), F.col("medium.precision").alias("medium_precision"), F.col("medium.recall").alias("medium_recall"), "average_precision",
    )


def canary(candidate: DataFrame, incumbent: DataFrame, min_improvement: float = 0.0) -> DataFrame:
    """Average precision of both on the same held-out rows; deploy if the candidate's is better by enough."""
    a = average_precision(candidate).withColumnRenamed("average_precision", "candidate_ap")
    b = average_precision(incumbent).withColumnRenamed("average_precision", "incumbent_ap")
    return a.join(b, CLASS).withColumn("improvement", F.col("candidate_ap") - F.col("incumbent_ap")).withColumn("deploy", F.col("improvement") >= min_improvement)


def fit_isotonic(scored: DataFrame) -> DataFrame:
    """threat_class, boundaries, predictions: a calibration curve for each class, never for a model's name."""
    curves = []
    for row in scored.select(CLASS).distinct().collect():  # one row for each of a handful of classes
        part = scored.where(F.col(CLASS) == row[0]).groupBy("score").agg(F.avg(F.col("y").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
        model = IsotonicRegression(labelCol="label", weightCol="weight").fit(VectorAssembler(inputCols=["score"], outputCol="features").transform(part))
        curves.append((row[0], [float(x) for x in model.boundaries], [float(x) for x in model.predictions]))
    return scored.sparkSession.createDataFrame(curves, "threat_class string, boundaries array<double>, predictions array<double>")


def interpolate(x: Column, boundaries: Column, predictions: Column) -> Column:
    """Linear between boundaries and held outside them; null without a curve."""
    above = F.size(F.filter(boundaries, lambda b: b <= x))
    at = lambda a, i: F.try_element_at(a, i)
    x0, x1, y0, y1 = at(boundaries, above), at(boundaries, above + 1), at(predictions, above), at(predictions, above + 1)
    inside = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    n = F.size(boundaries)
    return F.when(boundaries.isNull() | (n < 1) | x.isNull(), F.lit(None).cast("double")).when(above == 0, F.element_at(predictions, 1)).when(above >= n, F.element_at(predictions, -1)).otherwise(inside)


def calibrate(results: DataFrame, curves: DataFrame) -> DataFrame:
    """Adds calibrated_confidence; null for a class without a curve."""
    joined = results.join(curves, CLASS, "left")
    return joined.withColumn("calibrated_confidence", interpolate(F.col("raw_score"), F.col("boundaries"), F.col("predictions"))).drop("boundaries", "predictions")
