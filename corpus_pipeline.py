"""Stages from raw documents to packed sequences.

Each stage takes what its predecessor kept, as Parquet, and calls one operator. The two filters and the near-duplicate
stage drop rows, the surrogate stage rewrites texts, and the last stage returns the pieces of the packed sequences.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.cluster import ship
from netquarry.llm import packing, pii, quality, similar, toxicity
from netquarry.llm.queries import PII_KEY, WORDS, table
from netquarry.llm.store import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the model's limit."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five-word shingles, similarity of at least 0.8."""
    ship(spark)
    return similar.keep_first(docs, shingle=5, part=4, whole=5)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates; n_chars follows the new text."""
    ship(spark)
    new = pii.replaced(docs, PII_KEY)
    columns = [F.when(F.col("pii_mentions") > 0, F.length("text")).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    return new.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, WORDS, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_copies), ("private_data", hide_private), ("packing", pack)]

#: Tokenizers, fitted models and XXH64 have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
