"""Parsers on hand-packed bytes, capture files, flow CSV, intelligence feeds and configuration."""

import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from netquarry.sources import pcap, tables, wire


def ip(payload, protocol, src="10.0.0.1", dst="10.0.0.2", fragment=0):
    address = lambda a: bytes(map(int, a.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 1, fragment, 64, protocol, 0) + address(src) + address(dst) + payload


def tcp(flags=2, payload=b"", sport=1234, dport=443):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + payload


def udp(payload=b"", sport=5353, dport=53):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ethernet(packet, kind=0x0800, vlan=False):
    return b"\x02" * 12 + (struct.pack(">HH", 0x8100, 7) if vlan else b"") + struct.pack(">H", kind) + packet


def test_packets():
    p = wire.packet(ip(tcp(flags=0x12, payload=b"hi"), 6))
    assert (p["src_ip"], p["dst_ip"], p["protocol"], p["ttl"], p["src_port"], p["dst_port"], p["syn"], p["ack"], p["rst"], p["payload"], p["packet_size"]) == ("10.0.0.1", "10.0.0.2", "TCP", 64, 1234, 443, True, True, False, b"hi", 42)
    assert wire.packet(ethernet(ip(udp(b"x"), 17)))["packet_size"] == 43 and wire.packet(ethernet(ip(udp(b"x"), 17), vlan=True))["dst_port"] == 53
    assert wire.packet(ip(b"\x08\x00", 1))["protocol"] == "ICMP" and wire.packet(ip(b"\x08\x00", 1))["src_port"] is None
    assert wire.packet(ip(tcp(), 47))["protocol"] == "OTHER" and wire.packet(ip(tcp(), 6, fragment=5))["protocol"] == "OTHER"
    assert wire.packet(ip(tcp()[:6], 6))["protocol"] == "OTHER"


@pytest.mark.parametrize("raw", [None, b"", b"\x45", b"\x60" + b"\0" * 60, ethernet(ip(tcp(), 6), kind=0x86DD), b"\x02" * 13])
def test_no_packet(raw):
    assert wire.packet(raw) is None


def qname(name):
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"


def test_dns_messages():
    head = struct.pack(">HHHHHH", 77, 0x8183, 1, 2, 0, 0)
    question = qname("a.example.com") + struct.pack(">HH", 1, 1)
    a = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 300, 4) + bytes([1, 2, 3, 4])
    cname = b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 4) + b"\x01b\xc0\x0e"
    m = wire.dns(head + question + a + cname)
    assert (m["transaction_id"], m["is_response"], m["rcode_name"], m["questions"]) == (77, True, "NXDOMAIN", [{"qname": "a.example.com", "qtype": "A", "qclass": "IN"}])
    assert [(x["rrname"], x["rtype"], x["ttl"], x["rdata"]) for x in m["answers"]] == [("a.example.com", "A", 300, "1.2.3.4"), ("a.example.com", "CNAME", 60, "b.example.com")]
    whole = head + question + a + cname
    assert all(wire.dns(whole[:n]) is None for n in range(len(whole)))
    assert wire.dns(struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c" + b"\0" * 4) is None  # a pointer to itself
    assert wire.dns(None) is None


def hello(ciphers, extensions):
    body = struct.pack(">H", 0x0303) + b"\0" * 32 + b"\0" + struct.pack(f">H{len(ciphers)}H", 2 * len(ciphers), *ciphers) + b"\1\0"
    ext = b"".join(struct.pack(">HH", k, len(v)) + v for k, v in extensions)
    body += struct.pack(">H", len(ext)) + ext
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\1" + len(body).to_bytes(3, "big") + body


def test_client_hellos():
    raw = hello([0x1301, 0x0A0A], [(0, struct.pack(">HBH", 6, 0, 3) + b"a.b"), (16, struct.pack(">H", 3) + b"\x02h2"), (10, struct.pack(">HH", 2, 29)), (11, b"\1\0"), (13, struct.pack(">HH", 2, 0x0403)), (43, b"\2" + struct.pack(">H", 0x0304))])
    h = wire.client_hello(raw)
    assert h == {
        "legacy_version": 0x0303, "ciphers": [0x1301, 0x0A0A], "extensions": [0, 16, 10, 11, 13, 43], "sni": "a.b", "alpn_protocols": [b"h2"], "supported_groups": [29], "ec_point_formats": [0], "signature_algorithms": [0x0403],
        "supported_versions": [0x0304],
    }
    assert all(wire.client_hello(raw[:n]) is None for n in range(len(raw)))
    assert wire.client_hello(b"\x17" + raw[1:]) is None and wire.client_hello(None) is None and wire.client_hello(b"") is None


def test_garbage_never_raises():
    rng = random.Random(0)
    for _ in range(3000):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(90)))
        for parse in (wire.packet, wire.dns, wire.client_hello):
            parse(raw)
            parse(b"\x45" + raw)
            parse(b"\x16\x03\x01\x00\x40\x01\x00\x00\x3c" + raw)


def test_parsers_in_spark(spark):
    raws = [ip(udp(struct.pack(">HHHHHH", 7, 0, 1, 0, 0, 0) + qname("x.com") + struct.pack(">HH", 28, 1)), 17), b"junk", None]
    df = spark.createDataFrame([(r,) for r in raws], "raw binary").select(wire.parse_packet(F.col("raw")).alias("p"))
    rows = df.select("p.protocol", wire.parse_dns(F.col("p.payload"))["questions"][0]["qtype"].alias("q")).collect()
    assert [tuple(r) for r in rows] == [("UDP", "AAAA"), (None, None), (None, None)]


@pytest.fixture
def captures(tmp_path):
    packets = [(1_700_000_000_000_000 + i * 250_000, ip(tcp(sport=1000 + i), 6)) for i in range(5)]
    for k in range(3):
        with open(tmp_path / f"c{k}.pcap", "wb") as f:
            f.writelines(pcap.file_bytes(packets))
    return tmp_path, packets


def test_capture_files(spark, captures):
    folder, packets = captures
    pcap.register(spark)
    rows = spark.read.format("pcap").load(str(folder))
    assert rows.count() == 15 and sorted((r.ts_us, bytes(r.raw)) for r in rows.collect())[:3] == [packets[0]] * 3
    assert spark.read.format("pcap").option("limit", 2).load(str(folder / "c0.pcap")).count() == 2
    big = folder / "big.pcap"
    big.write_bytes(struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 101) + struct.pack(">IIII", 9, 5000, 3, 3) + b"abc" + struct.pack(">IIII", 9, 0, 50, 50) + b"cut off")
    assert list(pcap.read_file(str(big))) == [(9_000_005, b"abc")]
    (folder / "no.bin").write_bytes(b"nothing of the kind, at all")
    with pytest.raises(ValueError, match="no packet capture"):
        list(pcap.read_file(str(folder / "no.bin")))


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


@pytest.mark.parametrize("order", ["<", ">"])
def test_pcapng_files(tmp_path, order):
    """Two sections; interfaces of milliseconds, of 2 ** -20 seconds from a later second on, and of the default; each kind of packet block, and others."""
    section = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    clock = [block(order, 1, struct.pack(order + "HHI", 101, 0, 4) + more) for more in (
        struct.pack(order + "HH8sHHB3xHH", 2, 5, b"eth0\0", 9, 1, 3, 0, 0), struct.pack(order + "HHB3xHHq", 9, 1, 0x80 | 20, 14, 8, 100), b"")]
    packet = lambda at, time, raw, more=b"": block(order, 6, struct.pack(order + "5I", at, time >> 32, time & 0xFFFFFFFF, len(raw), 99) + raw + b"\0" * (-len(raw) % 4) + more)
    comment = struct.pack(order + "HH4sHH", 1, 4, b"note", 0, 0)
    old = block(order, 2, struct.pack(order + "HH4I", 2, 7, 0, 9, 3, 3) + b"old")
    data = section + b"".join(clock) + packet(0, 1 << 40, b"abcde", comment) + block(order, 5, b"statistics") + packet(1, 3 << 19, b"") + old + block(order, 3, struct.pack(order + "I", 9) + b"cut!")
    whole = [((1 << 40) * 1000, b"abcde"), (101_500_000, b""), (9, b"old"), (None, b"cut!")]
    again = section + clock[2] + packet(0, 5, b"x")
    path = tmp_path / "a.pcapng"
    path.write_bytes(data + again + packet(0, 6, b"cut off")[:-1])
    assert list(pcap.read_file(str(path))) == [*whole, (5, b"x")] and list(pcap.read_file(str(path), 2)) == whole[:2]
    path.write_bytes(data + packet(0, 6, b"y")[:4] + b"\1\0\0\1" + bytes(9))
    with pytest.raises(ValueError, match="has a block of"):
        list(pcap.read_file(str(path)))


def test_written_captures(spark, tmp_path):
    """Each packet goes to the format that holds its time; both are read from a folder, whatever its name."""
    folder = tmp_path / "a[b]"
    folder.mkdir()
    times = [0, (1_000_000 << 32) - 1, 1_000_000 << 32, -1, -(1 << 63), (1 << 63) - 1, None]
    packets = [(us, bytes(range(i))) for i, us in enumerate(times)]
    written = pcap.write_files(str(folder / "x"), packets)
    assert written == [f"{folder}/x.pcap", f"{folder}/x.pcapng"]
    for name in written:
        (folder / f"{name}.tmp").rename(name)
    assert list(pcap.read_file(written[0])) == packets[:2] and list(pcap.read_file(written[1])) == packets[2:]
    pcap.register(spark)
    assert sorted(map(repr, ((r.ts_us, bytes(r.raw)) for r in spark.read.format("pcap").load(str(folder)).collect()))) == sorted(map(repr, packets))
    assert pcap.write_files(str(folder / "none"), []) == []


def test_capture_stream(spark, captures, tmp_path):
    folder, _ = captures
    pcap.register(spark)
    stream = spark.readStream.format("pcap").load(str(folder))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.schema(pcap.SCHEMA).parquet(str(tmp_path / "out")).count() == 15


def test_a_capture_that_comes_late_is_read_once(spark, tmp_path):
    """Under a name before those already read, and after a restart."""
    pcap.register(spark)
    (tmp_path / "in").mkdir()

    def put(name, n):
        with open(tmp_path / "in" / name, "wb") as f:
            f.writelines(pcap.file_bytes([(i, ip(tcp(), 6)) for i in range(n)]))

    for name, n, total in (("b.pcap", 3, 3), ("a.pcap", 2, 5), ("c.pcap", 1, 6)):
        put(name, n)
        query = spark.readStream.format("pcap").load(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).start()
        query.processAllAvailable()
        query.stop()
        assert spark.read.schema(pcap.SCHEMA).parquet(str(tmp_path / "out")).count() == total


def test_flow_csv(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(" Flow Duration, Destination Port,Flow Bytes/s, Label\n12,443,Infinity,BENIGN\nx,53,1.5,DDoS\n")
    rows = tables.flow_records(spark, str(path), "cicids2017").collect()
    assert [(r.flow_duration, r.dst_port, r.label) for r in rows] == [(12.0, 443.0, "BENIGN"), (None, 53.0, "DDoS")] and rows[0].fwd_packets is None and rows[0].bytes_per_sec == float("inf")
    assert tables.flow_records(spark, str(path), "cicids2017", limit=1).count() == 1
    with pytest.raises(ValueError, match="dialect"):
        tables.flow_records(spark, str(path), "other")


def test_intel_feed(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"ja4": "a", "malware_family": "old"}, {"ja4": "a", "malware_family": "new"}, {"ja4": "b", "confidence": "HIGH"}, {"notes": "no key"}]))
    entries = tables.intel(spark, str(tmp_path / "in.json"))
    expect = {("a", "new", "MEDIUM"), ("b", None, "HIGH")}
    assert {(r.ja4, r.malware_family, r.confidence) for r in entries.collect()} == expect
    tables.export_intel(entries, str(tmp_path / "out"))
    assert {(r.ja4, r.malware_family, r.confidence) for r in tables.intel(spark, str(tmp_path / "out")).collect()} == expect


def test_config(spark, tmp_path):
    assert tables.config(spark, str(tmp_path)) == {}
    (tmp_path / "thresholds.yaml").write_text("classes:\n  ddos: {objective: f_beta, beta: 2.0, high_threshold: null, medium_threshold: 0.4}\n")
    (tmp_path / "sla_matrix.yaml").write_text("severities:\n  HIGH: {response_sla_minutes: null, primary_owner: tier1}\n")
    found = tables.config(spark, str(tmp_path))
    assert found["thresholds"].first().medium_threshold == 0.4 and found["sla"].first().primary_owner == "tier1"
    assert os.path.exists(tmp_path / "thresholds.yaml")
