"""The bounded flow lane: canonical keys, promotion, timeouts and flow vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import is_forward, ratio

KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]


@dataclass(frozen=True)
class Limits:
    """Microseconds, and packets needed for promotion."""

    threshold: int = 3
    ttl_us: int = 2_000_000
    inactive_us: int = 30_000_000
    active_us: int = 1_800_000_000


def canonical(packets: DataFrame) -> DataFrame:
    """Adds the direction-free key (a_ip, a_port, b_ip, b_port, protocol) and whether the packet goes from a to b."""
    ahead = is_forward(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    port = lambda c: F.coalesce(F.col(c), F.lit(0))
    pick = lambda yes, no: F.when(F.col("is_forward"), yes).otherwise(no)
    return packets.withColumn("is_forward", ahead).withColumns(
        {"a_ip": pick(F.col("src_ip"), F.col("dst_ip")), "a_port": pick(port("src_port"), port("dst_port")), "b_ip": pick(F.col("dst_ip"), F.col("src_ip")), "b_port": pick(port("dst_port"), port("src_port"))}
    )


FOLDED = "a_ip string, a_port int, b_ip string, b_port int, protocol string, event_id long, us long, packet_size int, syn boolean, is_forward boolean, seg int, confirmed boolean, first long, n int, gap_us long"
_CARRIED = [*KEY, "event_id", "us", "packet_size", "syn", "is_forward"]


def _fold(limits: Limits):
    """Labels packets that come sorted by (key, us, event_id), holding one flow's state at a time.

    A confirmed flow goes on until a timeout, a provisional run until its time to live; otherwise a new segment begins. A gap is the
    time since the last confirmed packet of the segment.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, confirmed, first, last, n, seg = None, False, 0, 0, 0, 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(KEY))]
            out: list[tuple] = []
            for at, t in zip(zip(*columns, strict=True), batch.column(len(KEY) + 1).to_pylist(), strict=True):
                if at != key:
                    key, confirmed, n, seg = at, False, 0, 0
                gap = None
                if confirmed and t - last <= limits.inactive_us and t - first <= limits.active_us:
                    n, gap = n + 1, t - last
                elif not confirmed and n and t - first <= limits.ttl_us:
                    n += 1
                    confirmed = n >= limits.threshold
                else:
                    seg, first, n = seg + 1, t, 1
                    confirmed = limits.threshold <= 1
                last = t
                out.append((seg, confirmed, first, n, gap))
            made = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=[c.split()[0] for c in FOLDED.split(", ")])

    return run


def promotion(packets: DataFrame, limits: Limits) -> DataFrame:
    """Canonical packets with seg, confirmed, first, n and gap_us.

    The rule is sequential, which no window function expresses. One shuffle by key and an external sort bring each flow's packets
    in order; they are folded as they stream by, so a flow of any length takes constant memory.
    """
    dealt = packets.select(F.col("a_ip"), F.col("a_port").cast("int"), "b_ip", F.col("b_port").cast("int"), "protocol", *_CARRIED[len(KEY) :])
    return dealt.repartition(*KEY).sortWithinPartitions(*KEY, "us", "event_id").mapInArrow(_fold(limits), FOLDED)


def labelled(packets: DataFrame, limits: Limits) -> DataFrame:
    return promotion(canonical(packets), limits)


def vectors(packets: DataFrame, limits: Limits) -> DataFrame:
    """One row for each confirmed flow segment: counts, directions, duration and gaps between confirmed packets.

    Packets before the promoting one count only as pre_promotion; gaps begin at the promoting packet.
    """
    sure = labelled(packets, limits).where("confirmed")
    way = lambda forward, what: F.sum(F.when(F.col("is_forward") == forward, what).otherwise(0))
    one, size, gap = F.lit(1), F.col("packet_size"), F.col("gap_us")
    sums = sure.groupBy(*KEY, "seg").agg(
        F.count("*").alias("packet_count"), F.sum(size).alias("byte_count"), F.sum(F.col("syn").cast("long")).alias("syn_count"), (F.min("n") - 1).cast("long").alias("pre_promotion_packet_count"),
        F.min("first").alias("first_us"), F.max("us").alias("last_us"),
        way(True, one).alias("fwd_packet_count"), way(True, size).alias("fwd_byte_count"), way(False, one).alias("bwd_packet_count"), way(False, size).alias("bwd_byte_count"),
        F.count(gap).alias("iat_n"), F.coalesce(F.avg(gap) / 1e6, F.lit(0.0)).alias("iat_mean"), F.coalesce(F.when(F.count(gap) > 1, F.var_pop(gap / 1e6)), F.lit(0.0)).alias("iat_variance"),
    )
    deviation = F.sqrt("iat_variance")
    return sums.withColumns(
        {
            "total_packets_seen": F.col("packet_count") + F.col("pre_promotion_packet_count"),
            "duration": (F.greatest("first_us", "last_us") - F.col("first_us")) / 1e6,
            "iat_std": deviation,
            "iat_cv": F.when(F.col("iat_mean") > 0, deviation / F.col("iat_mean")).otherwise(0.0),
            "byte_ratio_out": ratio(F.col("fwd_byte_count"), F.col("fwd_byte_count") + F.col("bwd_byte_count"), 0.5),
            "packet_ratio_out": ratio(F.col("fwd_packet_count"), F.col("fwd_packet_count") + F.col("bwd_packet_count"), 0.5),
        }
    )


def unpromoted(packets: DataFrame, limits: Limits) -> DataFrame:
    """Segments that never reached the threshold, with their packets."""
    rows = promotion(canonical(packets), limits)
    return rows.groupBy(*KEY, "seg").agg(F.max("n").alias("packets"), F.min("first").alias("first_us"), F.max("confirmed").alias("ever")).where(~F.col("ever")).drop("ever")


def timeouts(packets: DataFrame, limits: Limits, until_us: Column) -> DataFrame:
    """Confirmed segments that end by idleness or age before ``until_us``, and when: the earlier of both deadlines."""
    ends = F.least(F.col("last_us") + limits.inactive_us, F.col("first_us") + limits.active_us)
    flows = vectors(packets, limits).withColumn("expires_us", ends)
    return flows.where(F.col("expires_us") < until_us).withColumn("emission_reason", F.lit("flow_timeout"))
