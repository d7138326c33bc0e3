"""Analysts' verdicts: training labels, missed positives, samples and retraining guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
LABELS = ("TRUE_POSITIVE", "TRUE_POSITIVE_WRONG_CLASS", "FALSE_POSITIVE", "INCONCLUSIVE")
REASONS = ("alerted", "random", "boundary")
CLASSES = ("ddos", "c2_beaconing", "dga", "encrypted_malware", "port_scanning", "exfiltration")
LEAST_EXAMPLES = 20


def by_reason(verdicts: DataFrame, reason: str) -> DataFrame:
    if reason not in REASONS:
        raise ValueError(f"unknown sample reason {reason!r}")
    return verdicts.where(F.col("sample_reason") == reason)


def training_pairs(verdicts: DataFrame) -> DataFrame:
    """threat_class, flow_id, label of every verdict that tells something about a class; inconclusive ones don't."""
    named = F.array_distinct(F.filter(F.array("confirmed_threat_class", "model_predicted_class"), lambda c: c.isNotNull()))
    rows = verdicts.where(F.col("verdict") != "INCONCLUSIVE").withColumn("threat_class", F.explode(named))
    confirmed = F.coalesce(F.col("confirmed_threat_class") == F.col("threat_class"), F.lit(False))
    refuted = F.col("verdict").isin("FALSE_POSITIVE", "TRUE_POSITIVE_WRONG_CLASS")
    return rows.withColumn("label", F.when(confirmed, 1).when(refuted, 0)).where("label IS NOT NULL")


def missed_positive_rate(verdicts: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Share of conclusive random verdicts that confirm a class; null without any."""
    chosen = by_reason(verdicts, "random").where(F.col("verdict") != "INCONCLUSIVE")
    hit = lambda c: F.avg(F.coalesce((F.col("confirmed_threat_class") == c).cast("double"), F.lit(0.0)))
    wide = chosen.agg(*[hit(c).alias(c) for c in classes])
    return wide.unpivot([], list(classes), "threat_class", "missed_positive_rate")


def sample_random(results: DataFrame, rate: float, key: Column, seed: int = 0) -> DataFrame:
    """Exactly min(round(n x rate), n) rows without replacement, round half to even; the same rows for a seed."""
    n = results.count()
    take = max(0, min(round(n * rate), n))
    return results.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key).limit(take).withColumn("sample_reason", F.lit("random"))


def sample_boundary(results: DataFrame, threshold: float, top_n: int, order: str) -> DataFrame:
    """The ``top_n`` results closest to a threshold, ties in order of arrival."""
    distance = F.abs(F.coalesce("calibrated_confidence", "raw_score") - threshold)
    return results.orderBy(distance, order).limit(top_n).withColumn("sample_reason", F.lit("boundary"))


def retrain(rows: DataFrame, fit: Callable[[DataFrame], object], benign_only: bool = False, need: str | None = None, least: int = LEAST_EXAMPLES) -> object | None:
    """A new model, or None with fewer than ``least`` usable rows. ``benign_only`` keeps label 0 for models that learn what is
    normal; ``need`` drops rows without that column. The floor holds for what is left."""
    usable = rows.where("label = 0") if benign_only else rows
    usable = usable.where(F.col(need).isNotNull()) if need else usable
    return fit(usable) if usable.limit(least).count() >= least else None
