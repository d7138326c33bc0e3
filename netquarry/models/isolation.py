"""Isolation forests: trees grown in parallel on small samples, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import INPUTS, TRAINED, features, untrained


def path_left(n: float) -> float:
    """Mean depth of a search among n points that ends without a match."""
    if n <= 1:
        return 0.0
    return 1.0 if n <= 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """(input, cut, left, right, depth at a leaf) of each node; a leaf's input is -1."""
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(wide):
            nodes[at] = (-1, 0.0, at, at, depth + path_left(len(rows)))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(low[f], high[f]))
        inside = x[rows, f] <= cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        todo += [(nodes[at][2], rows[inside], depth + 1), (nodes[at][3], rows[~inside], depth + 1)]
    return nodes


class IsolationForest:
    """Higher raw_score is more anomalous: the forest's decision with its sign turned."""

    def __init__(self, threat_class: str, trees: int = 100, sample: int = 256, contamination: float | None = None, seed: int = 7):
        self.threat_class, self.trees, self.sample, self.contamination, self.seed = threat_class, trees, sample, contamination, seed
        self.forest: list[np.ndarray] = []
        self.offset, self.seen, self.size = -0.5, 0, sample

    def fit(self, rows: DataFrame) -> IsolationForest:
        """A new forest; what was learned before is replaced. A uniform sample of at most 16 x ``sample`` rows goes to the driver,
        whatever the table's size; every tree draws its own ``sample`` rows from it, and trees grow in parallel."""
        new = IsolationForest(self.threat_class, self.trees, self.sample, self.contamination, self.seed)
        columns = list(INPUTS[self.threat_class])
        x = features(rows, self.threat_class).select(*columns)
        new.seen = x.count()
        if not new.seen:
            return new
        chosen = x.orderBy(F.rand(self.seed)).limit(16 * self.sample).collect()
        data = np.array([tuple(r) for r in chosen], dtype=float).reshape(-1, len(columns))
        data = data[np.lexsort(data.T)]
        new.size = min(self.sample, len(data))
        spark, k, seed, size = rows.sparkSession, len(columns), self.seed, new.size

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for t in batch.id:
                    rng = np.random.default_rng((seed, int(t)))
                    nodes = grow(data[rng.choice(len(data), size, replace=False)].reshape(-1, k), rng)
                    yield pd.DataFrame(nodes, columns=["f", "cut", "l", "r", "depth"]).assign(tree=t)

        grown = spark.range(self.trees).mapInPandas(one, "f long, cut double, l long, r long, depth double, tree long").toPandas()
        new.forest = [g[["f", "cut", "l", "r", "depth"]].to_numpy() for _, g in grown.groupby("tree")]
        if self.contamination is not None:
            new.offset = float(np.quantile(-new._anomaly(data), self.contamination))
        return new

    def _anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean depth over the usual depth: near 1 for points that are easy to isolate."""
        depth = np.zeros(len(x))
        for tree in self.forest:
            at, f, cut, left, right = np.zeros(len(x), dtype=int), tree[:, 0].astype(int), tree[:, 1], tree[:, 2].astype(int), tree[:, 3].astype(int)
            while len(x) and (f[at] >= 0).any():
                at = np.where(f[at] < 0, at, np.where(x[np.arange(len(x)), f[at]] <= cut[at], left[at], right[at]))
            depth += tree[at, 4]
        return 2.0 ** (-depth / max(1, len(self.forest)) / max(path_left(self.size), 1e-9))

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Raw scores: above 0 is an anomaly."""
        return self._anomaly(x) + self.offset

    def score(self, rows: DataFrame) -> DataFrame:
        if not self.forest:
            return untrained(rows).withColumn("is_anomaly", F.lit(False))
        ready = features(rows, self.threat_class)

        @F.pandas_udf("double")
        def raw(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.decide(np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)))

        scored = ready.withColumn("raw_score", raw(*INPUTS[self.threat_class]))
        return scored.withColumns({"status": F.lit(TRAINED), "is_anomaly": F.col("raw_score") > 0})
