"""Jobs on the command line: ``python -m netquarry.jobs replay|thresholds|train --help``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship
from .models import saved
from .models.base import INPUTS
from .models.dga import DgaCascade
from .models.hoeffding import HoeffdingTree
from .models.isolation import IsolationForest
from .models.supervised import BACKENDS, Supervised
from .operators import thresholds
from .operators.verdicts import retrain
from .sources import pcap, tables, wire


def replay(spark: SparkSession, source: str, path: str, dialect: str = "cicids2017", limit: int | None = None) -> tuple[DataFrame, dict]:
    """Rows of a capture (parsed packets) or a flow file, and a summary: rows, rows a second, and counts by protocol or label."""
    began = time.time()
    if source == "pcap":
        ship(spark)
        pcap.register(spark)
        reader = spark.read.format("pcap")
        raw = (reader if limit is None else reader.option("limit", limit)).load(path)
        parsed = raw.select("ts_us", wire.parse_packet(F.col("raw")).alias("p"))
        rows = parsed.select("ts_us", F.coalesce("p.protocol", F.lit("unparsed")).alias("kind"), "p.*")
    elif source == "csv":
        rows = tables.flow_records(spark, path, dialect, limit).withColumn("kind", F.col("label"))
    else:
        raise ValueError(f"unknown source {source!r}; known are pcap and csv")
    counts = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}  # one row for each protocol or label
    n, seconds = sum(counts.values()), time.time() - began
    return rows, {"rows": n, "rows_per_second": round(n / max(seconds, 1e-9), 1), "by_kind": counts}


def fit_thresholds(spark: SparkSession, scored: str, out: str, config: str | None = None) -> DataFrame:
    """Class thresholds from a Parquet table of (threat_class, y, score), by the objectives of a configuration folder or the default ones."""
    found = tables.config(spark, config).get("thresholds") if config else None
    wanted = thresholds.objectives(spark) if found is None else found.select("threat_class", "objective", "beta", "min_precision")
    result = thresholds.class_thresholds(spark.read.parquet(scored), wanted)
    result.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def detector(spark: SparkSession, threat_class: str, rows: DataFrame, backend: str = "boosted", gate: float | None = None):
    """A class's own kind of detector, fitted to labelled rows; None with fewer than 20 usable ones.

    C2 and exfiltration learn what is normal, from benign rows alone; DDoS learns online, row by row in order of event_id (or of the
    first input, without one); names are counted into the Markov gate if benign, and rows without a domain are left out; the others are supervised.
    """
    ship(spark)
    if threat_class in ("c2_beaconing", "exfiltration"):
        return retrain(rows, IsolationForest(threat_class, contamination=0.05).fit, benign_only=True)
    if threat_class == "ddos":

        def learned(usable: DataFrame) -> HoeffdingTree:
            tree = HoeffdingTree()
            tree.learn_batch(usable, order="event_id" if "event_id" in usable.columns else INPUTS["ddos"][0])
            return tree

        return retrain(rows.where("label IS NOT NULL"), learned)
    if threat_class == "dga":
        return retrain(rows, DgaCascade(gate).fit, need="domain")
    return retrain(rows, Supervised(threat_class, backend).fit)


def train(spark: SparkSession, threat_class: str, vectors: str, out: str, backend: str = "boosted", gate: float | None = None) -> bool:
    """Fits :func:`detector` to a Parquet table of labelled vectors and saves it; False, and nothing saved, with too few rows."""
    model = detector(spark, threat_class, spark.read.parquet(vectors), backend, gate)
    if model is None:
        return False
    saved.save(spark, model, out)
    return True


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="netquarry.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("replay")
    job.add_argument("--source", choices=("pcap", "csv"), required=True)
    job.add_argument("--path", required=True)
    job.add_argument("--dialect", choices=tuple(tables.DIALECTS), default="cicids2017")
    job.add_argument("--limit", type=int)
    job = jobs.add_parser("thresholds")
    job.add_argument("--scored", required=True)
    job.add_argument("--out", required=True)
    job.add_argument("--config")
    job = jobs.add_parser("train")
    job.add_argument("--threat-class", choices=tuple(INPUTS), required=True)
    job.add_argument("--vectors", required=True)
    job.add_argument("--out", required=True)
    job.add_argument("--backend", choices=BACKENDS, default="boosted")
    job.add_argument("--gate", type=float, help="Markov score from which a name is benign")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("netquarry").getOrCreate()
    if a.job == "replay":
        print(replay(spark, a.source, a.path, a.dialect, a.limit)[1])
    elif a.job == "thresholds":
        fit_thresholds(spark, a.scored, a.out, a.config).show(truncate=False)
    else:
        print("saved" if train(spark, a.threat_class, a.vectors, a.out, a.backend, a.gate) else "too few examples")


if __name__ == "__main__":
    main()
