"""Command-line jobs and batch-wise sinks."""

import numpy as np
import pytest
from test_decisions import results
from test_sources import ip, tcp

from netquarry import jobs
from netquarry.models import saved
from netquarry.models.base import INPUTS
from netquarry.models.dga import DgaCascade
from netquarry.models.hoeffding import HoeffdingTree
from netquarry.models.isolation import IsolationForest
from netquarry.models.supervised import Supervised
from netquarry.operators import alerting
from netquarry.sources import pcap
from netquarry.streaming import sinks


def test_replay(spark, tmp_path):
    with open(tmp_path / "a.pcap", "wb") as f:
        f.writelines(pcap.file_bytes([(i, ip(tcp(), 6)) for i in range(4)] + [(5, b"junk")]))
    rows, summary = jobs.replay(spark, "pcap", str(tmp_path / "a.pcap"))
    assert summary["by_kind"] == {"TCP": 4, "unparsed": 1} and rows.count() == summary["rows"] == 5
    assert jobs.replay(spark, "pcap", str(tmp_path / "a.pcap"), limit=2)[1]["rows"] == 2
    (tmp_path / "f.csv").write_text("dur,label\n1,0\n2,1\n3,1\n")
    assert jobs.replay(spark, "csv", str(tmp_path / "f.csv"), "unsw-nb15")[1]["by_kind"] == {"0": 1, "1": 2}
    with pytest.raises(ValueError, match="source"):
        jobs.replay(spark, "live", "x")


def test_threshold_and_training_jobs(spark, tmp_path):
    spark.createDataFrame([("ddos", i % 2, i % 2 * 0.5 + i / 1000) for i in range(100)], "threat_class string, y int, score double").write.parquet(str(tmp_path / "scored"))
    got = jobs.fit_thresholds(spark, str(tmp_path / "scored"), str(tmp_path / "out")).first()
    assert got.threat_class == "ddos" and got.average_precision == pytest.approx(1)
    names = ", ".join(f"{c} double" for c in INPUTS["port_scanning"])
    rows = [(*[float(i % 2 * 9 + i % 5)] * 6, i % 2) for i in range(40)]
    spark.createDataFrame(rows, names + ", label int").write.parquet(str(tmp_path / "vectors"))
    assert jobs.train(spark, "port_scanning", str(tmp_path / "vectors"), str(tmp_path / "model"), "logistic") and (tmp_path / "model").exists()
    spark.createDataFrame(rows[:5], names + ", label int").write.parquet(str(tmp_path / "few"))
    assert not jobs.train(spark, "port_scanning", str(tmp_path / "few"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


@pytest.mark.parametrize("threat", sorted(INPUTS))
def test_each_class_trains_its_own_detector(spark, tmp_path, threat):
    """Saved, loaded and scoring as before; and held back by the floor of examples, which counts benign rows where only those are learned."""
    rng = np.random.default_rng(3)
    if threat == "dga":
        made = [(i, "".join(rng.choice(list("xqzjkv0123456789"), 12)) + ".net" if i % 2 else f"{rng.choice(['mail', 'news', 'shop', 'data'])}{rng.choice(['home', 'land', 'line'])}.com", i % 2) for i in range(60)]
        rows = spark.createDataFrame([*made, (99, None, 1)], "id long, domain string, label int")
    else:
        names = ", ".join(f"{c} double" for c in INPUTS[threat])
        rows = spark.createDataFrame([(*map(float, rng.normal(5 + 40 * (i % 3 == 0), 1, len(INPUTS[threat]))), int(i % 3 == 0), i) for i in range(90)], f"{names}, label int, event_id long")
    rows.write.parquet(str(tmp_path / "in"))
    kinds = {"ddos": HoeffdingTree, "c2_beaconing": IsolationForest, "exfiltration": IsolationForest, "dga": DgaCascade}
    model = jobs.detector(spark, threat, rows)
    assert type(model) is kinds.get(threat, Supervised)
    assert jobs.train(spark, threat, str(tmp_path / "in"), str(tmp_path / "model"))
    again = saved.load(spark, str(tmp_path / "model"))
    key = "id" if threat == "dga" else "event_id"
    before, after = ({r[key]: r.raw_score for r in m.score(rows.where("domain IS NOT NULL") if threat == "dga" else rows).collect()} for m in (model, again))
    assert before == pytest.approx(after)
    bad, good = ([before[r[key]] for r in rows.where(f"label = {y}").collect() if r[key] in before] for y in (1, 0))
    assert np.mean(bad) > np.mean(good)
    if threat in ("c2_beaconing", "exfiltration"):
        few = rows.where("label = 1").unionByName(rows.where("label = 0").limit(19))
    else:
        few = rows.where("id < 19 OR domain IS NULL") if threat == "dga" else rows.limit(19)
    few.write.parquet(str(tmp_path / "few"))
    assert not jobs.train(spark, threat, str(tmp_path / "few"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_online_learning_from_a_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = ", ".join(f"{c} double" for c in INPUTS["ddos"])
    rows = [(*map(float, rng.normal(100 + 900 * (i % 2), 5, 6)), i % 2 if i % 3 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, names + ", label int, event_id long")
    df.write.parquet(str(tmp_path / "in"))
    tree = HoeffdingTree()
    sinks.learn(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), tree, str(tmp_path / "progress")).awaitTermination()
    assert tree.seen == 40 and tree.chance([1000] * 6) > 0.9 > 0.1 > tree.chance([100] * 6)


def test_export_of_alerts(spark, tmp_path):
    limits = spark.createDataFrame([("ddos", 0.8, 0.5)], "threat_class string, high_threshold double, medium_threshold double")
    made = alerting.alerts(results(spark, (1, "ddos", 0.9, None, False), (2, "ddos", 0.6, None, False)), limits)
    made.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    sinks.export(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out" / "json")).count() == spark.read.text(str(tmp_path / "out" / "cef")).count() == 2
