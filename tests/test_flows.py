"""The flow lane: traces with explicit clocks, and the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from netquarry.operators import capacity, flows
from netquarry.operators.flows import Limits
from netquarry.streaming import flows as stream
from netquarry.streaming import windows as stream_windows

SCHEMA = "event_id long, us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, packet_size int, syn boolean"
S = 1_000_000


def trace(spark, *packets):
    """packets: (seconds, size, from a) of one pair of hosts."""
    rows = [(i, int(t * S), *(("a", 1, "b", 2) if ahead else ("b", 2, "a", 1)), "TCP", size, False) for i, (t, size, ahead) in enumerate(packets)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, limits, *packets):
    return [(r.seg, r.n, r.confirmed) for r in flows.labelled(trace(spark, *packets), limits).orderBy("event_id").collect()]


def test_promotion_loses_what_came_before(spark):
    v = flows.vectors(trace(spark, (10.0, 100, True), (10.1, 100, True), (10.2, 100, True)), Limits()).first()
    assert (v.total_packets_seen, v.pre_promotion_packet_count, v.packet_count, v.byte_count, v.first_us) == (3, 2, 1, 100, 10 * S)


def test_time_to_live_counts_from_the_first_packet(spark):
    limits = Limits(ttl_us=S)
    assert labels(spark, limits, (1, 1, True), (1.1, 1, True), (5, 1, True)) == [(1, 1, False), (1, 2, False), (2, 1, False)]
    assert labels(spark, limits, (1, 1, True), (1.6, 1, True), (2.2, 1, True))[-1] == (2, 1, False)
    assert labels(spark, limits, (1, 1, True), (1.6, 1, True), (2.0, 1, True))[-1] == (1, 3, True)  # exactly at the limit


def test_gaps_begin_at_the_promoting_packet(spark):
    v = flows.vectors(trace(spark, (100, 1, True), (100.5, 1, True), (101.5, 1, True), (103.5, 1, True)), Limits(threshold=2)).first()
    assert (v.iat_n, v.iat_mean) == (2, 1.5)


def test_directions_share_a_flow(spark):
    v = flows.vectors(trace(spark, (1, 40, True), (1.1, 1200, False), (1.2, 1200, False)), Limits(threshold=1)).first()
    assert v.byte_ratio_out == pytest.approx(40 / 2440) and (v.fwd_packet_count, v.bwd_packet_count) == (1, 2)


def test_timeouts_are_strict_and_need_new_promotion(spark):
    limits = Limits(threshold=1, inactive_us=30 * S, active_us=50 * S)
    assert labels(spark, limits, (0, 1, True), (30, 1, True), (60.1, 1, True)) == [(1, 1, True), (1, 2, True), (2, 1, True)]
    assert labels(spark, limits, (0, 1, True), (25, 1, True), (50, 1, True), (50.1, 1, True))[-2:] == [(1, 3, True), (2, 1, True)]
    two = Limits(threshold=2, inactive_us=S)
    assert labels(spark, two, (0, 1, True), (0.5, 1, True), (3, 1, True))[-1] == (2, 1, False)
    ended = flows.timeouts(trace(spark, (0, 1, True), (10, 1, True)), limits, F.lit(41 * S)).collect()
    assert [r.expires_us for r in ended] == [40 * S] and flows.timeouts(trace(spark, (0, 1, True)), limits, F.lit(30 * S)).count() == 0
    assert flows.unpromoted(trace(spark, (0, 1, True), (0.5, 1, True)), Limits()).first().packets == 2


def random_packets(spark, n=600):
    rng, rows, t = random.Random(3), [], 1_000 * S
    for i in range(n):
        t += rng.choice([S // 10, S // 2, 3 * S, 20 * S])
        a, b = ("10.0.0.%d" % rng.randrange(4), 1), ("10.9.0.1", 2)
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        rows.append((i, t, a[0], a[1], b[0], b[1], "TCP", rng.randrange(40, 900), rng.random() < 0.2))
    return spark.createDataFrame(rows, SCHEMA)


def in_order(packets, path, parts=3):
    """Files whose times of writing follow the packets' times, as a stream would see them."""
    low, high = packets.agg(F.min("us"), F.max("us")).first()
    for k in range(parts):
        part = F.floor((F.col("us") - low) * parts / (high - low + 1)) == k
        packets.where(part).coalesce(1).write.mode("append").parquet(path)


LIMITS = Limits(threshold=3, ttl_us=20 * S, inactive_us=30 * S, active_us=200 * S)
COMPARED = ["a_ip", "b_ip", "packet_count", "byte_count", "syn_count", "fwd_packet_count", "fwd_byte_count", "pre_promotion_packet_count", "first_us", "last_us"]


def test_the_stateful_step_agrees_with_the_fold(spark):
    packets = random_packets(spark)
    by_key = {}
    for r in flows.canonical(packets).orderBy("us", "event_id").collect():
        by_key.setdefault((r.a_ip, r.b_ip), []).append(r)
    found = set()
    for k, rows in by_key.items():
        state = None
        for r in rows:
            state, ended = stream.advance(state, r.us, r.packet_size, r.syn, r.is_forward, LIMITS)
            for s in (ended, state if r is rows[-1] and state[0] else None):
                if s:
                    found.add((*k, s[5], s[6], s[7], s[8], s[9], s[10], s[1], s[2]))
    assert found == {tuple(r) for r in flows.vectors(packets, LIMITS).select(*COMPARED).collect()}


def test_flow_stream_gives_the_batch_segments(spark, tmp_path):
    packets = random_packets(spark).withColumn("ts", F.timestamp_micros("us"))
    last = packets.agg(F.max("us")).first()[0]
    in_order(packets, str(tmp_path / "in"))
    late = [(10_000 + i, last + (i + 1) * 5_000 * S, "x", 1, "y", 2, "UDP", 40, False) for i in range(2)]  # rows that push the watermark past all flows
    for i, row in enumerate(late):
        spark.createDataFrame([row], SCHEMA).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = stream.flow_stream(source, LIMITS, "0 seconds")
    stream_windows.write(out, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("a_ip <> 'x'").select(*COMPARED)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in flows.vectors(random_packets(spark), LIMITS).select(*COMPARED).collect()}


def test_window_stream_gives_the_batch_windows(spark, tmp_path):
    packets = random_packets(spark).withColumn("ts", F.timestamp_micros("us"))
    in_order(packets, str(tmp_path / "in"))
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_windows.source_windows(source, "1 minute", "30 seconds")
    stream_windows.write(out, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = {(r.win, r.src_ip, r.packet_count, r.byte_count) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).select(F.unix_micros("w.start").alias("win"), "src_ip", "packet_count", "byte_count").collect()}
    batch = packets.groupBy((F.col("us") - F.col("us") % (60 * S)).alias("win"), "src_ip").agg(F.count("*"), F.sum("packet_size")).collect()
    closed = max(w for w, *_ in got)
    assert got == {tuple(r) for r in batch if r.win <= closed} and len(got) > 50


def test_bounded_tables(spark):
    rows = [(0, i, i, ip) for i, ip in enumerate(["a", "b", "a", "c", "b"])]  # capacity 2: b goes for c, then a for b
    got = capacity.lru(spark.createDataFrame(rows, "shard long, us long, event_id long, src_ip string"), 2, "shard").first()
    assert (got.tracked, got.evicted, got.counted) == (2, 2, 2)
    rows = [(0, 0, 0, "a"), (0, 1, 1, "b"), (0, 2, 2, "c"), (0, 20, 3, "d"), (0, 21, 4, "b")]
    got = capacity.admission(spark.createDataFrame(rows, "shard long, us long, event_id long, flow string"), 2, 5, "shard").first()
    assert (got.tracked, got.evicted, got.degraded) == (2, 1, 1)
