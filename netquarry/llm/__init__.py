"""Operators of a training-data pipeline over corpora of texts, vectors and web captures.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns
DataFrames; what must outlive a lost executor is written to the folder in ``spark.checkpoint.dir``.
"""
