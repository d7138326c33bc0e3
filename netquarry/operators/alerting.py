"""From scored detections to multi-label alerts, a review queue and exports.

Results: group_id, threat_class, model_name, raw_score, calibrated_confidence, ja4_known_bad, and the context's source_ip,
src_ip, dst_ip and flow fields; and, if they have any, evidence (a map of names to values), which alerts carry along as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import flow_id, stable_id

#: Ranks of severities.
RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
UNCALIBRATED = "uncalibrated: held against thresholds of the raw score"


def severity(score: Column, high: Column, medium: Column) -> Column:
    """A null threshold is never reached."""
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM")


def detections(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Results that reach a threshold of their class. The score is the calibrated one, or the raw one with a note; confidence is
    held within 0 and 1 and raw_score kept beside it."""
    limits = thresholds.select("threat_class", "high_threshold", "medium_threshold")
    scored = results.withColumn("score", F.coalesce("calibrated_confidence", "raw_score")).join(limits, "threat_class")
    found = scored.withColumn("severity", severity(F.col("score"), F.col("high_threshold"), F.col("medium_threshold"))).where("severity IS NOT NULL")
    return found.withColumns(
        {"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), "calibration_status": F.when(F.col("calibrated_confidence").isNull(), UNCALIBRATED)}
    ).drop("score", "high_threshold", "medium_threshold")


def below_threshold(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    limits = thresholds.select("threat_class", "high_threshold", "medium_threshold")
    score = F.coalesce("calibrated_confidence", "raw_score")
    return results.join(limits, "threat_class", "left").where(severity(score, F.col("high_threshold"), F.col("medium_threshold")).isNull()).drop("high_threshold", "medium_threshold")


def rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair]), level)


def overall_severity() -> Column:
    """The highest one; CRITICAL for two different classes at HIGH or any fingerprint known to be bad."""
    classes = F.size(F.collect_set(F.when(F.col("severity") == "HIGH", F.col("threat_class"))))  # at most six classes
    known_bad = F.coalesce(F.bool_or("ja4_known_bad"), F.lit(False))
    return F.when((classes >= 2) | known_bad, "CRITICAL").otherwise(F.max_by("severity", rank(F.col("severity"))))


def fused(method: str) -> Column:
    if method == "noisy_or":
        return 1 - F.product(1 - F.col("confidence"))
    if method == "max":
        return F.max("confidence")
    raise ValueError(f"unknown fusion method {method!r}; known are noisy_or and max")


def six_digits(score: Column) -> Column:
    """Rounded at the sixth digit, a half away from zero, by the scaled number: doubles a last bit below a half (0.5526314999999999) round up as halves."""
    return F.round(score * 1e6) / 1e6


def identity() -> dict[str, Column]:
    """source_ip, destination_ip and flow_id from whichever fields the context has."""
    flow = F.col("flow_src_ip").isNotNull()
    return {
        "source_ip": F.when(flow, F.col("flow_src_ip")).otherwise(F.coalesce(F.nullif("source_ip", F.lit("")), "src_ip")),
        "destination_ip": F.when(flow, F.col("flow_dst_ip")).otherwise(F.col("dst_ip")),
        "flow_id": F.when(flow, flow_id(F.col("flow_src_ip"), F.col("flow_src_port"), F.col("flow_dst_ip"), F.col("flow_dst_port"), F.col("flow_protocol"))),
    }


def alerts(results: DataFrame, thresholds: DataFrame, group: str = "group_id", method: str = "noisy_or", strict: bool = True) -> DataFrame:
    """One alert for each group with a detection; its detections in order of class and model. Source, destination and flow are those of
    one row: of those with a source the first with a flow, else a destination, in order of these, class and model.

    A group with detections but no source raises while the query runs (``strict``) or is left out.
    """
    found = detections(results, thresholds)
    entry = F.struct("threat_class", F.col("model_name").alias("model"), "confidence", "severity", "raw_score", "calibration_status", *[F.to_json("evidence").alias("evidence")] * ("evidence" in results.columns))
    known = identity()
    who = F.struct(known["flow_id"].isNull().alias("a"), known["destination_ip"].isNull().alias("b"), *[c.alias(k) for k, c in known.items()], "threat_class", "model_name")
    made = found.groupBy(group).agg(
        F.min(F.when(known["source_ip"].isNotNull(), who)).alias("who"), F.array_sort(F.collect_list(entry)).alias("detections"), overall_severity().alias("overall_severity"),
        fused(method).alias("overall_score"), F.count("*").alias("threats_detected_count"), F.max("observed_us").alias("observed_us"),
    )
    made = made.select(group, *[F.col("who")[k].alias(k) for k in known], *[c for c in made.columns if c not in (group, "who")])
    unknown = F.raise_error(F.concat(F.lit("no source for group "), F.col(group).cast("string"))).cast("string")
    made = made.withColumn("source_ip", F.coalesce("source_ip", unknown)) if strict else made.where("source_ip IS NOT NULL")
    return made.withColumns({"alert_id": F.concat(F.lit("ALT-"), stable_id(F.col(group), F.to_json("detections"))), "overall_score_method": F.lit(method)})


def as_json(made: DataFrame) -> DataFrame:
    """An object for each alert; its fused score has six digits, as the order of a product's factors decides the last ones."""
    shown = made.withColumn("overall_score", six_digits(F.col("overall_score")))
    return shown.select("alert_id", F.to_json(F.struct(*made.columns)).alias("json"))


def as_cef(made: DataFrame) -> DataFrame:
    """A line of the Common Event Format for each alert, for forwarding to a security information system."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), "=", r"\\=")
    classes = F.array_join(F.transform("detections", lambda d: d["threat_class"]), ",")
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit("netquarry"), F.lit("netquarry"), F.lit("1"), classes, F.lit("network threat"), (rank(F.col("overall_severity")) * 2 + 2).cast("string"))
    tail = F.concat(F.lit("|src="), escaped(F.col("source_ip")), F.lit(" dst="), escaped(F.col("destination_ip")), F.lit(" externalId="), F.col("alert_id"), F.lit(" cs1="), F.format_number(six_digits(F.col("overall_score")), 6))
    return made.select("alert_id", F.concat(head, tail).alias("line"))


def review_queue(made: DataFrame, sla: DataFrame) -> DataFrame:
    """Alerts by severity and score with their deadlines; no deadline where the matrix has no time."""
    joined = made.join(sla, made["overall_severity"] == sla["severity"], "left")
    late = F.col("observed_us") + F.col("response_sla_minutes") * 60_000_000
    ranked = joined.withColumns({"severity_rank": rank(F.col("overall_severity")), "respond_by_us": late})
    return ranked.orderBy(F.desc("severity_rank"), F.desc("overall_score"), "alert_id")
