"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import release, saved

BINS = 1024
LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v array<double>): each component as floor(256 x); without vectors or components that are null or
    not finite, and without null ids."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & F.col(id_column).isNotNull() & finite).select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.rint(F.floor(F.lit(256.0) * x.cast("double")).cast("double"))).alias("v")
    )


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """``n`` rows of about equal numbers of vectors, dealt by a hash of id and vector, in order of id; each in a partition of its own,
    up to 20,000 of them."""
    keyed = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n)).alias(name), F.struct("id", "v").alias("x"))
    return keyed.repartition(min(n, 20_000), "dim", name).groupBy("dim", name).agg(F.sort_array(F.collect_list("x")).alias(f"{name}_rows"))


def _matrix(rows: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    values = rows.values
    return values.field("id").to_numpy(), values.field("v").flatten().to_numpy().reshape(len(values), dim)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; where doubles could round, by Python's integers, held within long."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in c], dtype=object).reshape(c.shape).T
    return np.array([[min(max(s, LONG.min + 2), LONG.max - 2) for s in row] for row in exact], dtype=np.int64).reshape(len(q), len(c))


def _pairs(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """(dim, query block, position, query ids, lo, hi, candidate ids, scores, own) for a few queries at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            at = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            dim, qb = at["dim"].as_py(), at["qb"].as_py()
            qid, q = _matrix(at["qb_rows"], dim)
            cid, c = _matrix(at["cb_rows"], dim)
            lo, hi = at["lo"].values.to_numpy(), at["hi"].values.to_numpy()
            for p in range(0, len(qid), rows):
                part = slice(p, p + rows)
                yield dim, qb, np.arange(p, min(p + rows, len(qid))), qid[part], lo[part], hi[part], cid, scores(q[part], c), qid[part, None] == cid[None, :]


def bin_width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    span = (hi.astype(object) - lo.astype(object)).reshape(-1)
    return np.array([max(1, -(-int(s) // BINS)) for s in span], dtype=np.int64)


def _histograms(k: int):
    """Counts by bin of the scores in [lo, hi), from the top bin down to the one where this pair of blocks
    alone has k scores: lower bins can't hold the kth."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, qb, at, _, lo, hi, _, s, own in _pairs(batches):
            within = (s >= lo[:, None]) & (s < hi[:, None]) & ~own
            row, col = np.nonzero(within)
            bins = (s[row, col] - lo[row]) // bin_width(lo, hi)[row]
            count = np.bincount(row * BINS + bins, minlength=len(at) * BINS).reshape(len(at), BINS)
            above = count[:, ::-1].cumsum(axis=1)[:, ::-1] - count
            row, col = np.nonzero((count > 0) & (above < k))
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, qb, np.int64)), pa.array(at[row].astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(count[row, col].astype(np.int64))],
                names=["dim", "qb", "at", "bin", "n"],
            )

    return run


def _refine(k: int):
    """The bin that holds each query's kth score becomes its interval; ``above`` counts what lies over it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                lo, hi, above = (at[x].values.to_numpy().copy() for x in ("lo", "hi", "above"))
                count = np.zeros((len(lo), BINS), dtype=np.int64)
                if at["found"].is_valid:
                    f = at["found"].values
                    count[f.field("at").to_numpy(), f.field("bin").to_numpy()] = f.field("n").to_numpy()
                total = above[:, None] + count[:, ::-1].cumsum(axis=1)  # from the top bin down
                reached = (total >= k).argmax(axis=1)
                enough = total[:, -1] >= k
                width, kth = bin_width(lo, hi), BINS - 1 - reached
                rows = np.arange(len(lo))
                open_ = hi - lo > 1
                above = np.where(enough & open_, total[rows, reached] - count[rows, kth], above)
                new_lo = np.where(enough, lo + kth * width, LONG.min)  # fewer than k scores: all of them
                new_hi = np.where(enough, np.minimum(hi, new_lo + width), LONG.min + 1)
                lo, hi = np.where(open_, new_lo, lo), np.where(open_, new_hi, hi)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], *(pa.array([x], kind) for x in (lo, hi, above))], names=["dim", "qb", "lo", "hi", "above"])

    return run


def _select(k: int):
    """Scores over each query's kth value, and of those equal to it the k smallest ids of each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, qb, at, qid, lo, _, cid, s, own in _pairs(batches):
            tie = (s == lo[:, None]) & ~own
            row, col = np.nonzero(((s > lo[:, None]) & ~own) | (tie & (tie.cumsum(axis=1) <= k)))  # candidates are in order of id
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, qb, np.int64)), pa.array(at[row].astype(np.int32)), pa.array(qid[row]), pa.array(cid[col]), pa.array(s[row, col])],
                names=["dim", "qb", "at", "query_id", "vec_id", "score"],
            )

    return run


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = 1024, block_bytes: int = 1 << 21, send_bytes: int = 1 << 26
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    Queries are packed into blocks of about ``block_rows`` vectors and candidates into blocks of about ``block_bytes``; each pair of blocks is
    scored by one matrix product. Passes over all pairs count scores by bin in each query's interval, sum the counts of all
    pairs and narrow the interval to the bin that holds the kth score, until it is one value wide. A last pass returns
    only what reaches it, ties by the smaller id. No scores are stored, no block goes to the driver.

    Candidates are shuffled once, into their blocks. In each pass the queries come to them: broadcast if all queries' vectors have ``send_bytes`` at
    most, which is checked; otherwise every query block is sent to every candidate block, and tasks are as many as candidate blocks.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Only
    vectors of equal length are compared. Candidates with the query's own id are left out. A query with
    fewer than k candidates returns all, without any none. Repeated rows count each. Other columns are ignored.
    """
    c, q = usable(candidates, id_column, vector_column), usable(queries, id_column, vector_column)
    facts = c.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("dim")).first()
    asked = q.agg(F.count("*").alias("n"), F.sum(F.size("v") * 8 + 24).alias("bytes")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not facts.n or not asked.n:
        return queries.sparkSession.createDataFrame([], result)
    n = -(-facts.n // max(1, min(8 * block_rows, block_bytes // (8 * max(1, facts.dim)))))
    cb = saved(_blocks(c, n, "cb"), "candidates")
    bound = F.least(F.lit(float(2**62)), F.ceil(F.sqrt(F.lit(facts.m))) + 1.0)
    norm = lambda x: F.least(F.lit(float(2**62)), (F.sqrt(F.aggregate(x["v"], F.lit(0.0), lambda a, y: a + y * y)) + 1) * bound).cast("long")
    qb = saved(_blocks(q, -(-asked.n // block_rows), "qb"), "queries")
    state = saved(qb.select("dim", "qb", F.transform("qb_rows", lambda x: -norm(x)).alias("lo"), F.transform("qb_rows", lambda x: norm(x) + 1).alias("hi"), F.transform("qb_rows", lambda x: F.lit(0).cast("long")).alias("above")), "state")

    def pairs(state: DataFrame) -> DataFrame:
        full = qb.join(state.drop("above"), ["dim", "qb"])
        if asked.bytes <= send_bytes:
            met = cb.join(F.broadcast(full), "dim")
        else:
            met = cb.join(full.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).hint("merge"), ["dim", "cb"])
        return met.select("dim", "qb", "qb_rows", "cb_rows", "lo", "hi")

    while state.where(F.exists(F.zip_with("lo", "hi", lambda a, b: b - a > 1), lambda x: x)).limit(1).count():
        counts = pairs(state).mapInArrow(_histograms(k), "dim int, qb long, at int, bin int, n long")
        found = counts.groupBy("dim", "qb", "at", "bin").agg(F.sum("n").alias("n")).groupBy("dim", "qb").agg(F.collect_list(F.struct("at", "bin", "n")).alias("found"))
        narrowed = state.join(found, ["dim", "qb"], "left").select("dim", "qb", "lo", "hi", "above", "found")
        former, state = state, saved(narrowed.mapInArrow(_refine(k), "dim int, qb long, lo array<long>, hi array<long>, above array<long>"), "state")
        release(former)
    chosen = pairs(state).mapInArrow(_select(k), "dim int, qb long, at int, query_id long, vec_id long, score long")
    order = Window.partitionBy("dim", "qb", "at").orderBy(F.desc("score"), "vec_id")
    return chosen.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
