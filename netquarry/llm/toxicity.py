"""Toxicity: severity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, column
from .samples import labelled

WORD = regex.compile(r"\p{L}[\p{L}\p{M}']*")
PREFIXES = range(4, 9)


def features_of(word: str) -> tuple[str, ...]:
    return (f"w:{word}", *(f"p{n}:{word[:n]}" for n in PREFIXES if len(word) > n))


@dataclass
class Severity:
    """P(grade <= k) = sigmoid(cuts[k] - weights . x), with x the logarithms of 1 + a feature's count."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    reject: float = 0.5

    def counter(self):
        """A function from a text to its counts of features; words met before need one look-up."""
        known: dict[str, tuple[int, ...]] = {}
        index = self.vocabulary

        def count(text: str | None) -> Counter:
            found: Counter = Counter()
            if not text or not index:
                return found
            if len(known) > 1 << 19:
                known.clear()
            for word in WORD.findall(text.lower()):
                hits = known.get(word)
                if hits is None:
                    hits = known[word] = tuple(index[f] for f in features_of(word) if f in index)
                if hits:
                    found.update(hits)
            return found

        return count

    def matrix(self, counts: list[Counter]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.weights)))
        for row, found in enumerate(counts):
            for f, n in found.items():
                x[row, f] = np.log1p(n)
        return x

    def exceed(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k; the expected severity is their sum."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - (x @ self.weights)[:, None], -60, 60)))


def fit(x: np.ndarray, grades: np.ndarray, levels: int, ridge: float = 1e-4, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights, shared by all thresholds, and ascending thresholds of the proportional-odds model.

    Maximises the penalised likelihood by Adam over the whole sample; the thresholds are a first one and the
    logarithms of the gaps, so they stay in order.
    """
    n, width = x.shape
    params = np.concatenate([np.zeros(width), [1.0], np.zeros(levels - 2)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = params[:width], np.exp(params[width + 1 :])
        cuts = params[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = sigmoid(cuts[None, :] - (x @ w)[:, None])
        below = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        p = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-12)
        up, down = slope[rows, grades + 1] / p, slope[rows, grades] / p
        per_cut = np.zeros((n, levels + 1))
        per_cut[rows, grades + 1] += up
        per_cut[rows, grades] -= down
        dcuts = per_cut[:, 1:-1].mean(axis=0)
        grad = np.concatenate([-(x.T @ (up - down)) / n - ridge * w, [dcuts.sum()], [dcuts[k + 1 :].sum() * gaps[k] for k in range(levels - 2)]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])


def _present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        for text, label in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist(), strict=True):
            found = sorted({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.full(len(found), label, dtype=np.int32))], names=["feature", "label"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, most_features: int = 512, label: str = "toxic") -> Severity:
    """The model for about ``sample_rows`` labelled documents.

    Features are words and their first 4 to 8 letters; those that mark toxic documents most clearly (a
    score test of the shares of toxic and clean documents that have them), ``most_features`` at most, are kept. The
    labels know only toxic or not, so a toxic document's grade is 2 if it has more hits of these features than
    the median toxic one, else 1; a clean one's is 0. A document is rejected from an expected severity of 0.5, or
    less where clean documents of the sample stay far below (twice their largest, 0.05 at least). Only the chosen features and the sample's counts of them reach the
    driver. Without toxic or without clean labels nothing is toxic.
    """
    sample = labelled(docs, labels, label, sample_rows).persist()
    try:
        sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            return Severity({}, np.zeros(0), np.array([20.0, 40.0]))
        a, b = F.col("a") / toxic, F.col("b") / clean
        share = (F.col("a") + F.col("b")) / (toxic + clean)
        clear = (a - b) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-9)
        found = sample.mapInArrow(_present, "feature string, label int").groupBy("feature").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        best = found.where((F.col("a") >= max(5, toxic // 50)) & (a > 10 * b + 2.0 / clean)).select("feature", clear.alias("clear")).where("clear > 4").orderBy(F.desc("clear"), "feature").limit(most_features)
        model = Severity({r.feature: k for k, r in enumerate(sorted(best.collect(), key=lambda r: r.feature))}, np.zeros(0), np.zeros(2))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = model.counter()
            for batch in by_bytes(batches):
                found = [count(t) for t in column(batch, "text").to_pylist()]
                hits = pa.array([[{"f": f, "n": n} for f, n in sorted(c.items())] for c in found], pa.list_(pa.struct([("f", pa.int32()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "label"), hits], names=["doc_id", "label", "hits"])

        rows = sorted(sample.mapInArrow(run, "doc_id long, label int, hits array<struct<f:int,n:long>>").collect(), key=lambda r: r.doc_id)
    finally:
        sample.unpersist()
    counts = [Counter({h.f: h.n for h in r.hits}) for r in rows]
    total, y = np.array([sum(c.values()) for c in counts]), np.array([r.label for r in rows])
    grades = np.where(y == 0, 0, np.where(total > np.median(total[y == 1]), 2, 1))
    model.weights = np.zeros(len(model.vocabulary))
    x = model.matrix(counts)
    model.weights, model.cuts = fit(x, grades, 3)
    model.reject = float(np.clip(2 * model.exceed(x[grades == 0]).sum(axis=1).max(), 0.05, 0.5))
    return model


def _scored(batches: Iterable[pa.RecordBatch], model: Severity) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    count = model.counter()
    for batch in by_bytes(batches):
        yield batch, model.exceed(model.matrix([count(t) for t in column(batch, "text").cast(pa.string()).to_pylist()]))


def grade(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, p_toxic (chance of grade 1 or more), p_severe (of grade 2), severity (expected grade), toxic
    (whether severity reaches ``model.reject``) for every document's whole text.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text has no features, and the
    severity of a text without any. Null ids and repeated rows return like others; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, over in _scored(batches, model):
            severity = over.sum(axis=1)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *map(pa.array, (over[:, 0], over[:, 1], severity, severity >= model.reject))], names=["doc_id", "p_toxic", "p_severe", "severity", "toxic"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, p_toxic double, p_severe double, severity double, toxic boolean")


def clean(docs: DataFrame, model: Severity) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic, in one pass without a shuffle.

    A null or empty text has no features, so its row stays; rows with a null id and repeated rows are judged each by its text; a text of any
    length is read whole; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, over in _scored(batches, model):
            yield batch.filter(pa.array(over.sum(axis=1) < model.reject))

    return docs.mapInArrow(run, docs.schema)
