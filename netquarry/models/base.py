"""What every detector has: ``fit`` returns a fitted one, ``score`` adds raw_score and status to rows."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNTRAINED, TRAINED = "untrained", "trained"

#: Inputs of each model, in order.
INPUTS = {
    "ddos": ("packet_count", "byte_count", "unique_dest_ips_est", "unique_dest_ports_est", "syn_ratio", "protocol_entropy"),
    "port_scanning": ("unique_dest_ports_est", "dest_port_entropy", "unique_dest_ips_est", "syn_ratio", "protocol_entropy", "packet_count"),
    "c2_beaconing": ("packet_count", "duration", "iat_mean", "iat_std", "iat_cv", "iat_n"),
    "exfiltration": ("byte_ratio_out", "packet_ratio_out", "duration", "byte_count", "iat_mean", "iat_cv"),
    "dga": ("char_entropy", "bigram_entropy", "length", "digit_ratio", "vowel_ratio", "markov_score"),
    "encrypted_malware": ("num_ciphers", "num_extensions", "has_sni", "num_alpn_protocols", "num_supported_groups", "num_signature_algorithms", "num_ec_point_formats", "tls_version", "ja4_known_bad"),
}
#: What a missing input counts as, where not 0.
DEFAULTS = {"byte_ratio_out": 0.5, "packet_ratio_out": 0.5}


class Detector(Protocol):
    threat_class: str

    def score(self, rows: DataFrame) -> DataFrame: ...


def features(rows: DataFrame, threat_class: str) -> DataFrame:
    """``rows`` with the model's inputs as doubles; a missing column or null has its default."""
    has = set(rows.columns)
    value = lambda c: F.lit(DEFAULTS.get(c, 0.0))
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), value(c)) if c in has else value(c) for c in INPUTS[threat_class]})


def untrained(rows: DataFrame) -> DataFrame:
    """The cold start of every detector: score 0 and a status that says so."""
    return rows.withColumns({"raw_score": F.lit(0.0), "status": F.lit(UNTRAINED)})
