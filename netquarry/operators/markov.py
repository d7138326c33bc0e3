"""Character Markov models of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = "^"


def transitions(df: DataFrame, text: str, order: int = 2) -> DataFrame:
    """A row for each character of each string: its context of ``order`` characters before, and itself."""
    s = F.col(text)
    padded = F.concat(F.lit(PAD * order), s)
    at = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.struct(F.substr(padded, i, F.lit(order)).alias("ctx"), F.substr(s, i, F.lit(1)).alias("ch")))
    return df.where(F.length(s) > 0).withColumn("at", F.explode(at)).select("*", "at.ctx", "at.ch").drop("at")


def fit(strings: DataFrame, text: str, order: int = 2, earlier: DataFrame | None = None) -> DataFrame:
    """ctx, ch, n: transition counts; added to those of an earlier fit if given."""
    counts = transitions(strings, text, order).groupBy("ctx", "ch").agg(F.count("*").alias("n"))
    return counts if earlier is None else counts.unionByName(earlier.select("ctx", "ch", "n")).groupBy("ctx", "ch").agg(F.sum("n").alias("n"))


def score(df: DataFrame, key: str, text: str, model: DataFrame, order: int = 2, smoothing: float = 1.0) -> DataFrame:
    """key and the mean logarithm of its transitions' smoothed chances; null for an empty string or model. ``model`` is read three times: store it first."""
    alphabet = model.select(F.countDistinct("ch").alias("alphabet"))
    totals = model.groupBy("ctx").agg(F.sum("n").alias("ctx_n"))
    steps = transitions(df.select(key, text), text, order).groupBy(key, "ctx", "ch").agg(F.count("*").alias("times"))
    size = alphabet.first().alphabet  # one number
    looked = steps.join(model, ["ctx", "ch"], "left").join(totals, "ctx", "left")
    chance = (F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("ctx_n", F.lit(0)) + smoothing * max(size, 1))
    mean = F.sum(F.col("times") * F.ln(chance)) / F.sum("times")
    scored = looked.groupBy(key).agg((mean if size else F.lit(None).cast("double")).alias("score"))
    return df.select(key).distinct().join(scored, key, "left")


def gate(score, threshold: float | None):
    """Whether the cascade stops at the gate: a threshold is set and the score reaches it."""
    return F.lit(False) if threshold is None else F.coalesce(score >= threshold, F.lit(False))
