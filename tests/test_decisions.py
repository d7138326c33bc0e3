"""Thresholds, calibration, alerts and verdicts."""

import pytest
from pyspark.sql import functions as F

from netquarry.operators import alerting, lookups, thresholds, verdicts


def scored(spark, rows, threat="ddos"):
    return spark.createDataFrame([(threat, y, float(s)) for y, s in rows], "threat_class string, y int, score double")


def test_average_precision_is_stepwise(spark):
    assert thresholds.average_precision(scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])).first().average_precision == pytest.approx(0.8333, abs=1e-4)
    assert thresholds.average_precision(scored(spark, [(0, 0.1), (0, 0.4)])).first().average_precision == 0


def test_class_thresholds(spark):
    good = [(0, i / 1000) for i in range(100)] + [(1, 0.8 + i / 1000) for i in range(100)]
    wanted = thresholds.objectives(spark, [("ddos", "f1", None, None)])
    t = thresholds.class_thresholds(scored(spark, good), wanted).first()
    assert t.medium_threshold == 0.8 and t.average_precision == t.high_recall == 1
    assert t.high_threshold == 0.095  # of equal recalls the lowest threshold that is precise enough
    flat = [(1 - i % 2, (i * 37 % 200) / 200) for i in range(200)]
    t = thresholds.class_thresholds(scored(spark, flat), thresholds.objectives(spark, [("ddos", "f_beta_or_min_precision", 2.0, 0.99)])).first()
    assert t.medium_threshold is not None and t.medium_recall > 0.9
    t = thresholds.class_thresholds(scored(spark, [(0, 0.9), (1, 0.5), (0, 0.1)]), thresholds.objectives(spark, [("ddos", "min_precision", None, 0.9)])).first()
    assert t.medium_threshold is None and t.high_threshold is None
    with pytest.raises(ValueError, match="objective"):
        thresholds.objectives(spark, [("ddos", "best", None, None)])


def test_isotonic_curves_by_class(spark):
    rows = scored(spark, [(0, -1), (0, 0), (1, 1)], "c2").union(scored(spark, [(0, 0.0), (0, 0.1), (1, 0.2)], "exfil"))
    curves = thresholds.fit_isotonic(rows)
    asked = spark.createDataFrame([("c2", -100.0), ("c2", 0.5), ("c2", 100.0), ("exfil", 0.08), ("other", 1.0)], "threat_class string, raw_score double")
    got = {(r.threat_class, r.raw_score): r.calibrated_confidence for r in thresholds.calibrate(asked, curves).collect()}
    assert got == {("c2", -100.0): 0.0, ("c2", 0.5): 0.5, ("c2", 100.0): 1.0, ("exfil", 0.08): 0.0, ("other", 1.0): None}


def test_canary(spark):
    good, bad = scored(spark, [(0, 0.1), (1, 0.9)]), scored(spark, [(0, 0.9), (1, 0.1)])
    assert thresholds.canary(good, bad, 0.1).first().deploy and not thresholds.canary(bad, good, 0.0).first().deploy
    assert thresholds.canary(good, good, 0.0).first().deploy


RESULT = "group_id int, threat_class string, model_name string, raw_score double, calibrated_confidence double, ja4_known_bad boolean, source_ip string, src_ip string, dst_ip string, flow_src_ip string, flow_src_port int, flow_dst_ip string, flow_dst_port int, flow_protocol string, observed_us long"


def results(spark, *rows):
    """rows: group, class, raw, calibrated, known bad."""
    return spark.createDataFrame([(g, c, "m", raw, cal, bad, "10.0.0.1", None, None, None, None, None, None, None, 0) for g, c, raw, cal, bad in rows], RESULT)


@pytest.fixture(scope="module")
def limits(spark):
    rows = [("ddos", 0.85, 0.5), ("dga", 0.75, 0.5), ("c2", None, 0.4), ("none", None, None)]
    return spark.createDataFrame(rows, "threat_class string, high_threshold double, medium_threshold double")


def test_alert_tiers_and_fusion(spark, limits):
    rows = results(spark, (1, "ddos", 0.9, None, False), (1, "dga", 0.1, 0.8, False), (2, "ddos", 0.6, None, True), (3, "ddos", 0.3, None, True), (4, "c2", 7.0, None, False), (5, "none", 1.0, None, False), (6, "ddos", 0.85, None, False))
    got = {r.group_id: r for r in alerting.alerts(rows, limits).collect()}
    assert set(got) == {1, 2, 4, 6}  # nothing below a threshold, nothing without one
    assert got[1].overall_severity == "CRITICAL" and got[1].overall_score == pytest.approx(0.98) and got[1].threats_detected_count == 2
    assert got[2].overall_severity == "CRITICAL" and got[6].overall_severity == "HIGH" and got[4].overall_severity == "MEDIUM"
    assert got[4].detections[0].confidence == 1.0 and got[4].detections[0].raw_score == 7.0 and got[4].detections[0].calibration_status == alerting.UNCALIBRATED
    assert [d.calibration_status is None for d in got[1].detections] == [False, True]
    assert got[1].alert_id == {r.group_id: r for r in alerting.alerts(rows, limits).collect()}[1].alert_id
    assert {r.group_id: r.overall_score for r in alerting.alerts(rows, limits, method="max").collect()}[1] == 0.9
    with pytest.raises(ValueError, match="fusion"):
        alerting.alerts(rows, limits, method="mean")


def test_alert_needs_a_source_only_when_it_alerts(spark, limits):
    quiet = results(spark, (1, "ddos", 0.1, None, False)).withColumn("source_ip", F.lit(None).cast("string"))
    assert alerting.alerts(quiet, limits).count() == 0
    loud = results(spark, (1, "ddos", 0.9, None, False)).withColumn("source_ip", F.lit(""))
    with pytest.raises(Exception, match="no source for group 1"):
        alerting.alerts(loud, limits).collect()
    assert alerting.alerts(loud, limits, strict=False).count() == 0


def test_exports_and_queue(spark, limits):
    made = alerting.alerts(results(spark, (1, "ddos", 0.9, None, False), (2, "ddos", 0.6, None, False)), limits)
    assert '"overall_severity":"HIGH"' in alerting.as_json(made).where(F.col("json").contains('"group_id":1')).first().json
    assert alerting.as_cef(made).first().line.startswith("CEF:0|netquarry|netquarry|1|ddos|")
    sla = spark.createDataFrame([("HIGH", 15), ("MEDIUM", None)], "severity string, response_sla_minutes long")
    queue = alerting.review_queue(made, sla).collect()
    assert [(r.overall_severity, r.respond_by_us) for r in queue] == [("HIGH", 900_000_000), ("MEDIUM", None)]


VERDICT = "flow_id string, feature_vector_version string, sample_reason string, verdict string, confirmed_threat_class string, model_predicted_class string"


def test_training_pairs(spark):
    rows = [
        ("f1", "v", "alerted", "TRUE_POSITIVE", "ddos", "ddos"), ("f2", "v", "alerted", "FALSE_POSITIVE", None, "ddos"), ("f3", "v", "alerted", "TRUE_POSITIVE_WRONG_CLASS", "dga", "ddos"),
        ("f4", "v", "alerted", "INCONCLUSIVE", None, "ddos"), ("f5", "v", "random", "TRUE_POSITIVE", "dga", None),
    ]
    df = spark.createDataFrame(rows, VERDICT)
    got = {(r.threat_class, r.flow_id, r.label) for r in verdicts.training_pairs(df).collect()}
    assert got == {("ddos", "f1", 1), ("ddos", "f2", 0), ("ddos", "f3", 0), ("dga", "f3", 1), ("dga", "f5", 1)}
    assert verdicts.by_reason(df, "random").count() == 1
    with pytest.raises(ValueError, match="reason"):
        verdicts.by_reason(df, "other")
    store = spark.createDataFrame([("f1", "v", 1, 5), ("f1", "v", 2, 6), ("f2", "w", 1, 7)], "flow_id string, feature_vector_version string, nth int, x int")
    last = lookups.latest(store, ["flow_id", "feature_vector_version"], "nth")
    assert [(r.flow_id, r.x) for r in lookups.training_rows(df, last).collect()] == [("f1", 6)] and lookups.training_skipped(df, last).first().skipped == 4


def test_missed_positive_rate(spark):
    rows = [("a", "v", "random", "TRUE_POSITIVE", "ddos", None), ("b", "v", "random", "FALSE_POSITIVE", None, None), ("c", "v", "random", "FALSE_POSITIVE", None, None), ("d", "v", "boundary", "TRUE_POSITIVE", "ddos", None), ("e", "v", "random", "INCONCLUSIVE", None, None)]
    df = spark.createDataFrame(rows, VERDICT)
    rate = {r.threat_class: r.missed_positive_rate for r in verdicts.missed_positive_rate(df).collect()}
    assert rate["ddos"] == pytest.approx(1 / 3) and rate["dga"] == 0
    assert {r.missed_positive_rate for r in verdicts.missed_positive_rate(df.where("false")).collect()} == {None}


def test_samples(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") / 50.0).alias("raw_score"), F.lit(None).cast("double").alias("calibrated_confidence"))
    assert verdicts.sample_random(df, 0.05, F.col("id")).count() == 2  # 2.5 rounds to even
    assert verdicts.sample_random(df, 3.0, F.col("id")).count() == 50
    assert {r.id for r in verdicts.sample_random(df, 0.2, F.col("id"), 1).collect()} == {r.id for r in verdicts.sample_random(df, 0.2, F.col("id"), 1).collect()}
    assert [r.id for r in verdicts.sample_boundary(df, 0.5, 3, "id").collect()] == [25, 24, 26]


def test_lookup_and_hit_rate(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "ja4 string")
    intel = spark.createDataFrame([("a", "fam")], "ja4 string, malware_family string")
    assert lookups.hit_rate(lookups.lookup(seen, intel)).first().hit_rate == 0.5
    assert tuple(lookups.hit_rate(lookups.lookup(seen.where("false"), intel)).first()) == (0, 0, 0.0)
