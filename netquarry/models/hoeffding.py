"""An online tree for streams of labelled vectors (Hoeffding bound, Gaussian naive Bayes leaves)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import INPUTS, TRAINED, features, untrained


class Leaf:
    """Counts, means and summed squares of each class and input."""

    def __init__(self, width: int):
        self.n, self.mean, self.m2, self.since = np.zeros(2), np.zeros((2, width)), np.zeros((2, width)), 0

    def learn(self, x: np.ndarray, y: int) -> None:
        self.n[y] += 1
        delta = x - self.mean[y]
        self.mean[y] += delta / self.n[y]
        self.m2[y] += delta * (x - self.mean[y])
        self.since += 1

    def chance(self, x: np.ndarray) -> float | None:
        """P(class 1), by the prior and those inputs that vary within every class seen; None before any example."""
        seen = self.n > 0
        if not seen.any():
            return None
        if not seen.all():
            return float(seen[1])
        var = self.m2 / np.maximum(self.n - 1, 1)[:, None]
        use = (var > 0).all(axis=0)
        logp = np.log(self.n / self.n.sum())
        if use.any():
            v = var[:, use]
            logp = logp - 0.5 * (np.log(2 * math.pi * v) + (x[use] - self.mean[:, use]) ** 2 / v).sum(axis=1)
        p = np.exp(logp - logp.max())
        return float(p[1] / p.sum())

    def best_splits(self, tries: int = 10) -> list[tuple[float, int, float]]:
        """(gain, input, cut), best first, from the classes' normal distributions."""

        def entropy(n: np.ndarray) -> float:
            p = n[n > 0] / max(n.sum(), 1e-12)
            return float(-(p * np.log2(p)).sum())

        found = []
        std = np.sqrt(self.m2 / np.maximum(self.n - 1, 1)[:, None])
        for f in range(self.mean.shape[1]):
            low, high = (self.mean - 2 * std)[:, f].min(), (self.mean + 2 * std)[:, f].max()
            best = (0.0, f, low)
            for cut in np.linspace(low, high, tries + 2)[1:-1] if high > low else []:
                below = np.array([self.n[c] * (0.5 * (1 + math.erf((cut - self.mean[c, f]) / (std[c, f] * math.sqrt(2)))) if std[c, f] > 0 else float(self.mean[c, f] <= cut)) for c in (0, 1)])
                above, total = self.n - below, self.n.sum()
                best = max(best, (entropy(self.n) - below.sum() / total * entropy(below) - above.sum() / total * entropy(above), f, float(cut)))
            found.append(best)
        return sorted(found, reverse=True)


class HoeffdingTree:
    threat_class = "ddos"

    def __init__(self, grace: int = 200, delta: float = 1e-7, tie: float = 0.05):
        self.grace, self.delta, self.tie, self.seen = grace, delta, tie, 0
        self.width = len(INPUTS[self.threat_class])
        self.nodes: list = [Leaf(self.width)]

    def _leaf(self, x: np.ndarray) -> int:
        at = 0
        while not isinstance(self.nodes[at], Leaf):
            f, cut, left, right = self.nodes[at]
            at = left if x[f] <= cut else right
        return at

    def learn(self, x, y: int | None) -> None:
        """One example; without a label there is nothing to learn."""
        if y is None:
            return
        x = np.asarray(x, dtype=float)
        at = self._leaf(x)
        leaf = self.nodes[at]
        leaf.learn(x, int(bool(y)))
        self.seen += 1
        if leaf.since < self.grace or not leaf.n.all():
            return
        leaf.since = 0
        first, second = leaf.best_splits()[:2]
        bound = math.sqrt(math.log(1 / self.delta) / (2 * leaf.n.sum()))
        if first[0] > 0 and (first[0] - second[0] > bound or bound < self.tie):
            self.nodes[at] = (first[1], first[2], len(self.nodes), len(self.nodes) + 1)
            self.nodes += [Leaf(self.width), Leaf(self.width)]

    def chance(self, x) -> float:
        x = np.asarray(x, dtype=float)
        return self.nodes[self._leaf(x)].chance(x) or 0.0

    def learn_batch(self, rows: DataFrame, label: str = "label", order: str = "event_id") -> None:
        """Learns a micro-batch of labelled vectors in order; they arrive at the driver as a stream, not all at once."""
        ready = features(rows.where(F.col(label).isNotNull()), self.threat_class).orderBy(order)
        for r in ready.select(*INPUTS[self.threat_class], label).toLocalIterator():
            self.learn(r[:-1], r[-1])

    def score(self, rows: DataFrame) -> DataFrame:
        if not self.seen:
            return untrained(rows)

        @F.pandas_udf("double")
        def raw(*columns: pd.Series) -> pd.Series:
            return pd.Series([self.chance(x) for x in zip(*columns, strict=True)], dtype=float)

        return features(rows, self.threat_class).withColumns({"raw_score": raw(*INPUTS[self.threat_class]), "status": F.lit(TRAINED)})
