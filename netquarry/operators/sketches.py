"""Count-Min sketches as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(keys: DataFrame, value: str, width: int, depth: int) -> DataFrame:
    rows = keys.withColumn("row", F.explode(F.array(*map(F.lit, range(depth)))))
    return rows.withColumn("cell", F.pmod(F.xxhash64(F.col(value), F.col("row")), F.lit(width)).cast("int"))


def cms_build(df: DataFrame, group: str, value: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """group, row, cell, n. Values are counted before they are hashed, so the rows written follow the different values."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return _cells(counted, value, width, depth).groupBy(group, "row", "cell").agg(F.sum("n").alias("n"))


def cms_estimate(sketch: DataFrame, points: DataFrame, group: str, value: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """group, value, estimate for each of ``points``: the least of its cells, never under the true count; 0 if unknown."""
    asked = _cells(points.select(group, value).distinct(), value, width, depth)
    found = asked.join(sketch, [group, "row", "cell"], "left")
    return found.groupBy(group, value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
