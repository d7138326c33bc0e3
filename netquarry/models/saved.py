"""Detectors on disk: a folder with a description, and what else the detector consists of."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from .dga import DgaCascade
from .hoeffding import HoeffdingTree, Leaf
from .isolation import IsolationForest
from .supervised import Supervised


def _tree(model: HoeffdingTree) -> dict:
    nodes = [{"n": x.n.tolist(), "mean": x.mean.tolist(), "m2": x.m2.tolist(), "since": x.since} if isinstance(x, Leaf) else list(x) for x in model.nodes]
    return {"grace": model.grace, "delta": model.delta, "tie": model.tie, "seen": model.seen, "nodes": nodes}


def _as_tree(state: dict) -> HoeffdingTree:
    model = HoeffdingTree(state["grace"], state["delta"], state["tie"])
    model.seen, model.nodes = state["seen"], []
    for x in state["nodes"]:
        if isinstance(x, dict):
            leaf = Leaf(model.width)
            leaf.n, leaf.mean, leaf.m2, leaf.since = np.array(x["n"]), np.array(x["mean"]), np.array(x["m2"]), x["since"]
            model.nodes.append(leaf)
        else:
            model.nodes.append(tuple(x))
    return model


def save(spark: SparkSession, model, path: str) -> None:
    """Replaces what is there."""
    state: dict = {"kind": type(model).__name__, "threat_class": model.threat_class}
    if isinstance(model, HoeffdingTree):
        state |= _tree(model)
    elif isinstance(model, IsolationForest):
        state |= {"trees": model.trees, "sample": model.sample, "contamination": model.contamination, "seed": model.seed, "offset": model.offset, "seen": model.seen, "size": model.size, "forest": [t.tolist() for t in model.forest]}
    elif isinstance(model, DgaCascade):
        state |= {"gate": model.gate, "rounds": model.rounds}
        model.markov.write.mode("overwrite").parquet(f"{path}/markov")
        model.classifier.model.write().overwrite().save(f"{path}/pipeline")
    elif isinstance(model, Supervised):
        state |= {"backend": model.backend, "depth": model.depth, "rounds": model.rounds}
        model.model.write().overwrite().save(f"{path}/pipeline")
    else:
        raise ValueError(f"no way to save a {type(model).__name__}")
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def load(spark: SparkSession, path: str):
    state = json.loads(spark.read.text(f"{path}/description").first()[0])
    if state["kind"] == "HoeffdingTree":
        return _as_tree(state)
    if state["kind"] == "IsolationForest":
        model = IsolationForest(state["threat_class"], state["trees"], state["sample"], state["contamination"], state["seed"])
        model.offset, model.seen, model.size, model.forest = state["offset"], state["seen"], state["size"], [np.array(t) for t in state["forest"]]
        return model
    if state["kind"] == "DgaCascade":
        model = DgaCascade(state["gate"], state["rounds"])
        model.markov, model.classifier.model = spark.read.parquet(f"{path}/markov"), PipelineModel.load(f"{path}/pipeline")
        return model
    model = Supervised(state["threat_class"], state["backend"], state["depth"], state["rounds"])
    model.model = PipelineModel.load(f"{path}/pipeline")
    return model
