"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..cluster import forget, scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage ends there, and
    what is read again neither runs twice nor depends on an executor that may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(table: DataFrame) -> None:
    """Deletes a table of :func:`saved` that nothing will read again; others go when the driver ends."""
    forget(table.sparkSession, table.scratch_path)


def free(df: DataFrame, name: str) -> str:
    """``name``, or the first longer form of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
