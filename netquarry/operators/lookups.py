"""Dimension tables: intelligence entries, feature vectors, and joins with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import ratio


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: what is added again overwrites. An aggregate with partial sums, no sort."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("x")).select(*keys, "x.*")


def lookup(df: DataFrame, intel: DataFrame, key: str = "ja4") -> DataFrame:
    """Left join on the fingerprint; ``hit`` tells whether it is known. The planner broadcasts a small table."""
    known = intel.withColumn("hit", F.lit(True))
    return df.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_rate(looked: DataFrame) -> DataFrame:
    hits = F.sum(F.col("hit").cast("long"))
    return looked.agg(F.count("*").alias("lookups"), F.coalesce(hits, F.lit(0)).alias("hits"), ratio(hits, F.count("*"), 0.0).alias("hit_rate"))


def training_rows(verdicts: DataFrame, store: DataFrame) -> DataFrame:
    """Verdicts with the feature vector of the version that they judged."""
    return verdicts.join(store, ["flow_id", "feature_vector_version"])


def training_skipped(verdicts: DataFrame, store: DataFrame) -> DataFrame:
    return verdicts.join(store, ["flow_id", "feature_vector_version"], "left_anti").agg(F.count("*").alias("skipped"))


def nth(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
