"""Running statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(x: Column) -> dict[str, Column]:
    """n, mean, population variance and deviation, and coefficient of variation; 0 where undefined. Spark's central
    moments merge stably, so large offsets cost no precision."""
    mean = F.coalesce(F.avg(x), F.lit(0.0))
    variance = F.when(F.count(x) > 1, F.var_pop(x)).otherwise(0.0)
    return {"n": F.count(x), "mean": mean, "variance": variance, "std": F.sqrt(variance), "cv": F.when(mean > 0, F.sqrt(variance) / mean).otherwise(0.0)}


def summary(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in moments(x).items()])


def sample_variance(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.var_samp(x)).otherwise(0.0)


def gaps(df: DataFrame, keys: list[str], us: str, order: list[str]) -> DataFrame:
    """Seconds since the row before in arrival order, which may be negative; a key's first row has none."""
    return df.withColumn("gap", (F.col(us) - F.lag(us).over(Window.partitionBy(*keys).orderBy(*order))) / 1e6).where("gap IS NOT NULL")
