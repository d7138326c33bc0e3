"""Quality rules: boosted trees over document statistics, in flat arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, column
from .samples import labelled

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "bang_rate", "pipe_rate", "distinct_rate", "line_words", "stop_rate")
#: The chance of being good may only fall when one of these rises.
FALLING = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "pipe_rate")


def repeated(words: list[bytes]) -> tuple[int, int]:
    """Words inside windows of five words that occur twice or more, and the number of different words."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.uint64)
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0, len(index)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0, len(index)
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)  # hashes only propose: the windows themselves are compared
    windows = np.stack([ids[at + k] for k in range(WINDOW)], axis=1)
    _, back, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[back.reshape(-1)] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((edge.cumsum() > 0).sum()), len(index)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text; a null is an empty one."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n, count = len(words), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=128)
    spaces = int(sum(count[ord(c)] for c in SPACE))
    symbols = int(sum(count[ord(c)] for c in SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    duplicate = len(lines) - len(set(lines))
    again, distinct = repeated(words)
    word_chars = len(text) - spaces
    per_word, per_char = max(1, n), max(1, word_chars)
    features = [
        np.log1p(n), word_chars / per_word, symbols / per_word, duplicate / max(1, len(lines)), again / per_word, int(count[65:91].sum()) / per_char,
        int(count[48:58].sum()) / per_char, int(count[33]) / per_word, int(count[124]) / per_word, distinct / per_word, n / max(1, len(lines)), int(count[46]) / per_word,
    ]
    return [n, word_chars, symbols, duplicate, again], features


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float
    cut: float = 0.2

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of being good of every row, all rows and trees stepping down together."""
        rows, at = np.arange(len(x))[:, None], np.tile(self.roots, (len(x), 1))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0, falling: tuple[int, ...] = ()) -> Trees:
    """Gradient boosting for log loss by histograms of quantile bins.

    For a falling feature a split stands only if its right leaf is not above its left one, and the values below
    the split stay on their side of the middle. Without rows, or with one class, there are no trees.
    """
    good = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    start, roots, nodes = float(np.log(good / (1 - good))), [], []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(x) else x
    margin = np.full(len(y), start)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append(None)
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            value = lambda gs, hs: np.clip(gs / (hs + ridge), low, high)  # noqa: B023, E731
            gain = lambda gs, hs, w: gs * w - (hs + ridge) * w * w / 2
            gt, ht = g[rows].sum(), h[rows].sum()
            own, best = value(gt, ht), None
            for f in range(x.shape[1] if level < depth and len(rows) >= 2 * least else 0):
                b, m = binned[rows, f], len(edges[f]) + 1
                gl, hl, nl = (np.bincount(b, w, m).cumsum()[:-1] for w in (g[rows], h[rows], None))
                wl, wr = value(gl, hl), value(gt - gl, ht - hl)
                won = gain(gl, hl, wl) + gain(gt - gl, ht - hl, wr) - gain(gt, ht, own)
                won[(nl < least) | (len(rows) - nl < least)] = -np.inf
                if f in falling:
                    won[wr > wl] = -np.inf
                if len(won) and won.max() > (best[0] if best else 1e-6):
                    best = (won.max(), f, int(won.argmax()), wl[won.argmax()], wr[won.argmax()])
            if best is None:
                nodes[at] = (0, np.inf, at, at, rate * own)
                margin[rows] += rate * own
                continue
            _, f, k, wl, wr = best
            left, right = len(nodes), len(nodes) + 1
            nodes[at] = (f, edges[f][k], left, right, 0.0)
            nodes += [None, None]
            middle, inside = (wl + wr) / 2, binned[rows, f] <= k
            sides = ((middle, high), (low, middle)) if f in falling else ((low, high), (low, high))
            todo += [(left, rows[inside], level + 1, *sides[0]), (right, rows[~inside], level + 1, *sides[1])]
    flat = [np.array(c) for c in zip(*nodes, strict=True)] if nodes else [np.zeros(0, dtype=t) for t in (int, float, int, int, float)]
    return Trees(*flat, np.array(roots, dtype=np.int64), depth, start)


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in by_bytes(batches):
        both = [statistics(t) for t in column(batch, "text").cast(pa.string()).to_pylist()]
        yield batch, np.array([b for b, _ in both], dtype=np.int64).reshape(-1, len(BASE)), np.array([f for _, f in both]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, label: str = "quality") -> Trees:
    """Trees fitted to about ``sample_rows`` labelled documents; their features, not texts, go to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, x in _measured(batches):
            rows = pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), rows, column(batch, "label")], names=["doc_id", "x", "label"])

    rows = sorted(labelled(docs, labels, label, sample_rows).mapInArrow(run, "doc_id long, x array<double>, label int").collect())
    x, y = np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], dtype=float)
    return fit(x, y, falling=tuple(FEATURES.index(f) for f in FALLING))


def verdicts(base: np.ndarray, x: np.ndarray, model: Trees) -> tuple[np.ndarray, np.ndarray]:
    failed = base_failed(base[:, 0], base[:, 4])
    return failed, ~failed & (model.score(x) >= model.cut)


def assess(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, the five base counts, base_failed and kept for every document.

    A document fails the base if it has fewer than 10 words or over 20 % repeated ones; one that doesn't is
    kept if the trees give it a chance of ``model.cut`` or more of being good.

    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty and so fails. Null ids and
    repeated rows return like others; an empty table gives no rows; a text of any length is measured whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, base, x in _measured(batches):
            failed, kept = verdicts(base, x, model)
            arrays = [column(batch, "doc_id"), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *BASE, "base_failed", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, kept boolean")


def keep(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`assess` keeps, in one pass without a shuffle.

    A null or empty text has no words and goes; rows with a null id and repeated rows are judged each by its text; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, base, x in _measured(batches):
            yield batch.filter(pa.array(verdicts(base, x, model)[1]))

    return docs.mapInArrow(run, docs.schema)
