"""Detectors: cold start, separation, gates and guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.models.base import INPUTS, features
from netquarry.models.hoeffding import HoeffdingTree
from netquarry.models.isolation import IsolationForest
from netquarry.models.supervised import Supervised, dga_cascade
from netquarry.operators import verdicts


def frame(spark, threat, data, label=None):
    columns = list(INPUTS[threat])
    rows = [tuple(map(float, x)) + ((int(y),) if label is not None else ()) for x, y in zip(data, label if label is not None else [0] * len(data), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + (", label int" if label is not None else ""))


def test_missing_inputs_have_defaults(spark):
    got = features(spark.createDataFrame([(None,)], "duration double"), "exfiltration").select(*INPUTS["exfiltration"]).first()
    assert tuple(got) == (0.5, 0.5, 0.0, 0.0, 0.0, 0.0)


def test_hoeffding_cold_start_and_single_leaf(spark):
    tree = HoeffdingTree()
    row = frame(spark, "ddos", [[1] * 6])
    assert tuple(tree.score(row).select("raw_score", "status").first()) == (0.0, "untrained")
    tree.learn([1] * 6, None)
    assert tree.seen == 0
    tree.learn([1] * 6, 1)
    assert tree.chance([1] * 6) > 0.9
    tree.learn([1] * 6, 0)
    assert tree.chance([1] * 6) == tree.chance([9] * 6) == 0.5


def test_hoeffding_separates_with_a_constant_input(spark):
    rng = np.random.default_rng(0)
    normal, attack = rng.normal(100, 10, (400, 6)), rng.normal(5000, 300, (400, 6))
    normal[:, 3] = attack[:, 3] = 1
    tree = HoeffdingTree()
    data, label = np.concatenate([normal, attack]), [0] * 400 + [1] * 400
    order = rng.permutation(800)
    rows = frame(spark, "ddos", data[order], np.array(label)[order]).withColumn("event_id", F.monotonically_increasing_id())
    tree.learn_batch(rows)
    assert tree.seen == 800 and tree.chance(attack.mean(axis=0)) > 0.8 and tree.chance(normal.mean(axis=0)) < 0.2
    assert tree.score(rows).where("abs(raw_score - label) > 0.2").count() == 0


def test_hoeffding_grows_by_the_bound():
    rng, tree = np.random.default_rng(1), HoeffdingTree()
    for _ in range(3000):
        x = rng.uniform(size=6)
        tree.learn(x, int(x[2] > 0.5))
    assert len(tree.nodes) > 1 and tree.nodes[0][0] == 2


@pytest.mark.parametrize(("threat", "normal", "odd"), [("c2_beaconing", ([12, 30, 2.0, 1.2, 0.6, 11], [4, 10, 0.6, 0.4, 0.15, 4]), [60, 600, 10, 0.05, 0.005, 59]), ("exfiltration", ([0.3, 0.5, 20, 9000, 0.5, 0.9], [0.08, 0.05, 6, 2500, 0.1, 0.2]), [0.97, 0.8, 900, 5e7, 0.02, 0.1])])
def test_isolation_forest_orders_outliers(spark, threat, normal, odd):
    rng = np.random.default_rng(2)
    rows = frame(spark, threat, rng.normal(*map(np.array, normal), (200, 6)))
    cold = IsolationForest(threat).score(rows).first()
    assert (cold.raw_score, cold.status, cold.is_anomaly) == (0.0, "untrained", False)
    forest = IsolationForest(threat, contamination=0.05).fit(rows)
    out, usual = forest.score(frame(spark, threat, [odd])).first(), forest.score(rows)
    assert out.is_anomaly and out.raw_score > usual.agg(F.avg("raw_score")).first()[0] + 0.1
    assert 3 <= usual.where("is_anomaly").count() <= 20
    assert forest.fit(rows.limit(50)).seen == 50  # a new fit replaces the old one


@pytest.mark.parametrize("backend", ["logistic", "boosted"])
def test_supervised_separates(spark, backend):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal([2, 0.5, 2, 0.1, 0.3, 20], 0.3, (100, 6)), rng.normal([200, 6, 3, 0.9, 0.1, 400], 5, (100, 6))])
    rows = frame(spark, "port_scanning", data, [0] * 100 + [1] * 100)
    assert Supervised("port_scanning", backend).score(rows).first().status == "untrained"
    means = {r.label: r.m for r in Supervised("port_scanning", backend).fit(rows).score(rows).groupBy("label").agg(F.avg("raw_score").alias("m")).collect()}
    assert means[1] > 0.8 and means[0] < 0.2
    with pytest.raises(ValueError, match="backend"):
        Supervised("port_scanning", "other")


def test_cascade_gates_before_the_classifier(spark):
    rows = spark.createDataFrame([(1, -1.0), (2, -5.0), (3, None)], "id int, markov_score double")
    got = {r.id: (r.raw_score, r.status) for r in dga_cascade(rows, -2.0, Supervised("dga")).collect()}
    assert got == {1: (0.0, "gated_benign"), 2: (0.0, "untrained"), 3: (0.0, "untrained")}
    assert {r.status for r in dga_cascade(rows, None, Supervised("dga")).collect()} == {"untrained"}


def test_retraining_floors(spark):
    rows = spark.createDataFrame([(i % 2, f"d{i}" if i % 3 else None) for i in range(42)], "label int, domain string")
    count = lambda df: df.count()
    assert verdicts.retrain(rows, count) == 42 and verdicts.retrain(rows, count, benign_only=True) == 21
    assert verdicts.retrain(rows.limit(30), count, benign_only=True) is None and verdicts.retrain(rows.limit(19), count) is None
    assert verdicts.retrain(rows, count, need="domain") == 28


def test_score_ddos_learns_every_window(spark, monkeypatch):
    from netquarry.plans import catalog

    seen, score = [], HoeffdingTree.score
    monkeypatch.setattr(HoeffdingTree, "score", lambda self, rows: seen.append(self.seen) or score(self, rows))
    n = catalog.score_ddos(spark, "/root/testdata/sf0.01").count()
    assert seen == [n] and n > 500
