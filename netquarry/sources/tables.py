"""Flow records in CSV, intelligence feeds in JSON, and configuration."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import latest
from ..operators.thresholds import objectives

#: The columns of two public data sets' files, their names here, and where the label is.
DIALECTS = {
    "cicids2017": (
        "Label",
        {
            "Flow Duration": "flow_duration", "Total Fwd Packets": "fwd_packets", "Total Backward Packets": "bwd_packets", "Total Length of Fwd Packets": "fwd_bytes",
            "Total Length of Bwd Packets": "bwd_bytes", "Flow Bytes/s": "bytes_per_sec", "Flow Packets/s": "packets_per_sec", "Fwd Packet Length Mean": "fwd_pkt_len_mean",
            "Bwd Packet Length Mean": "bwd_pkt_len_mean", "Flow IAT Mean": "iat_mean", "Flow IAT Std": "iat_std", "SYN Flag Count": "syn_flag_count", "Destination Port": "dst_port",
        },
    ),
    "unsw-nb15": (
        "label",
        {
            "dur": "flow_duration", "spkts": "fwd_packets", "dpkts": "bwd_packets", "sbytes": "fwd_bytes", "dbytes": "bwd_bytes", "rate": "packets_per_sec", "sttl": "src_ttl", "dttl": "dst_ttl",
            "proto": "protocol", "service": "service", "state": "tcp_state",
        },
    ),
}
TEXT = ("protocol", "service", "tcp_state")


def number(c: Column) -> Column:
    """A double if the text is one, else null; the text itself stays in a column of its own."""
    return F.expr(f"try_cast(trim(`{c}`) AS double)") if isinstance(c, str) else c.try_cast("double")


def flow_records(spark: SparkSession, path: str, dialect: str, limit: int | None = None) -> DataFrame:
    """Flow features by their names here, numbers as doubles, and the label in a column of its own.

    Headers are trimmed; a mapped column that the file lacks is null. Everything is read as text, without inference.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known are {', '.join(DIALECTS)}")
    label, names = DIALECTS[dialect]
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    pick = lambda c: F.trim(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(*[(pick(c) if to in TEXT else pick(c).try_cast("double")).alias(to) for c, to in names.items()], pick(label).alias("label"))
    return rows if limit is None else rows.limit(limit)


def intel(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON list; only ja4 is required, and of several with the same ja4 the last counts."""
    kind = "ja4 string, malware_family string, threat_actor string, confidence string, source string, first_seen string, notes string"
    raw = spark.read.schema(kind).option("multiLine", True).json(path).where("ja4 IS NOT NULL").select("ja4", "malware_family", "threat_actor", "confidence", "source", "first_seen", "notes").withColumn("nth", F.monotonically_increasing_id())
    filled = {"confidence": "MEDIUM", "source": "unknown", "notes": ""}
    return latest(raw.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()}), ["ja4"], "nth")


def export_intel(entries: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """JSON lists as :func:`intel` reads them, each file a list of about ``rows_per_file`` entries."""
    n = max(1, -(-entries.count() // rows_per_file))
    part = F.pmod(F.xxhash64("ja4"), F.lit(n)).cast("int")
    lists = entries.groupBy(part.alias("part")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("ja4", *[c for c in entries.columns if c != "ja4"])))).alias("value"))
    lists.repartition(n, "part").write.mode("overwrite").partitionBy("part").text(path)


def config(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """thresholds and sla tables from a folder's YAML files, on any store that Spark reads; a missing file is skipped."""
    import yaml

    def read(name: str) -> dict | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return yaml.safe_load(spark.read.text(str(path), wholetext=True).first()[0])

    found = {}
    if loaded := read("thresholds.yaml"):
        classes = loaded["classes"]
        rows = [(c, x.get("objective", "f_beta"), x.get("beta"), x.get("min_precision")) for c, x in classes.items()]
        limits = spark.createDataFrame([(c, x.get("high_threshold"), x.get("medium_threshold")) for c, x in classes.items()], "threat_class string, high_threshold double, medium_threshold double")
        found["thresholds"] = objectives(spark, rows).join(limits, "threat_class")
    if loaded := read("sla_matrix.yaml"):
        levels = loaded["severities"]
        rows = [(s, x.get("response_sla_minutes"), x.get("resolution_sla_minutes"), x.get("primary_owner"), x.get("escalates_to")) for s, x in levels.items()]
        found["sla"] = spark.createDataFrame(rows, "severity string, response_sla_minutes long, resolution_sla_minutes long, primary_owner string, escalates_to string")
    return found
