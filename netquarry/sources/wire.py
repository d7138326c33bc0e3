"""Packets on the wire: IPv4 headers, DNS messages and TLS ClientHellos, parsed in Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.network import QTYPES, RCODES

PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP"}
PACKET = "src_ip string, dst_ip string, protocol string, packet_size int, ttl int, src_port int, dst_port int, syn boolean, ack boolean, fin boolean, rst boolean, psh boolean, payload binary"
DNS = "transaction_id int, is_response boolean, rcode int, rcode_name string, questions array<struct<qname:string,qtype:string,qclass:string>>, answers array<struct<rrname:string,rtype:string,ttl:bigint,rdata:string>>"
HELLO = (
    "legacy_version int, ciphers array<int>, extensions array<int>, supported_groups array<int>, ec_point_formats array<int>, signature_algorithms array<int>, supported_versions array<int>, sni string, alpn_protocols array<binary>"
)


def ipv4(raw: bytes | None) -> tuple[memoryview, int] | None:
    """The IPv4 packet inside a frame, and its header's length; None for anything else.

    A first half-byte of 4 means bare IPv4, 6 bare IPv6; all else is taken for Ethernet, with VLAN tags if any.
    """
    if not raw:
        return None
    view, kind = memoryview(raw), raw[0] >> 4
    if kind == 6:
        return None
    if kind != 4:
        at = 12
        while len(view) >= at + 4 and struct.unpack_from(">H", view, at)[0] in (0x8100, 0x88A8):
            at += 4
        if len(view) < at + 2 or struct.unpack_from(">H", view, at)[0] != 0x0800:
            return None
        view = view[at + 2 :]
    if len(view) < 20 or view[0] >> 4 != 4:
        return None
    head = (view[0] & 15) * 4
    return (view, head) if 20 <= head <= len(view) else None


def packet(raw: bytes | None) -> dict | None:
    found = ipv4(raw)
    if found is None:
        return None
    ip, head = found
    total, fragment = struct.unpack_from(">H", ip, 2)[0], struct.unpack_from(">H", ip, 6)[0] & 0x1FFF
    body = ip[head : max(head, total)] if total else ip[head:]
    protocol = PROTOCOLS.get(ip[9], "OTHER") if not fragment else "OTHER"
    out = {
        "src_ip": ".".join(map(str, ip[12:16])), "dst_ip": ".".join(map(str, ip[16:20])), "protocol": protocol, "packet_size": len(raw), "ttl": ip[8],
        "src_port": None, "dst_port": None, "syn": False, "ack": False, "fin": False, "rst": False, "psh": False, "payload": b"",
    }
    if protocol == "TCP" and len(body) >= 20:
        flags, start = body[13], (body[12] >> 4) * 4
        out |= dict(zip(("src_port", "dst_port"), struct.unpack_from(">HH", body), strict=True))
        out |= {"syn": bool(flags & 2), "ack": bool(flags & 16), "fin": bool(flags & 1), "rst": bool(flags & 4), "psh": bool(flags & 8), "payload": bytes(body[start:])}
    elif protocol == "UDP" and len(body) >= 8:
        out |= dict(zip(("src_port", "dst_port"), struct.unpack_from(">HH", body), strict=True)) | {"payload": bytes(body[8:])}
    elif protocol in ("TCP", "UDP"):
        out["protocol"] = "OTHER"  # cut off before its ports
    return out


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A domain name, following compression pointers backwards only, and where its own bytes end."""
    labels, end, jumps = [], None, 0
    while True:
        n = data[at]
        if n & 0xC0 == 0xC0:
            to = (n & 0x3F) << 8 | data[at + 1]
            end = at + 2 if end is None else end
            jumps += 1
            if to >= at or jumps > 64:
                raise ValueError("a pointer that does not point back")
            at = to
        elif n & 0xC0:
            raise ValueError("an unknown kind of label")
        elif n:
            if at + 1 + n > len(data):
                raise ValueError("a label is cut off")
            labels.append(data[at + 1 : at + 1 + n])
            at += n + 1
        else:
            return b".".join(labels).decode("utf-8", "replace"), at + 1 if end is None else end


def dns(data: bytes | None) -> dict | None:
    """A DNS message; None if the bytes are none."""
    try:
        ident, flags, n_questions, n_answers = struct.unpack_from(">HHHH", data)
        at, questions, answers = 12, [], []
        for _ in range(n_questions):
            name, at = _name(data, at)
            questions.append({"qname": name, "qtype": QTYPES.get(struct.unpack_from(">H", data, at)[0], "OTHER"), "qclass": "IN"})
            at += 4
        for _ in range(n_answers):
            name, at = _name(data, at)
            kind, _, ttl, size = struct.unpack_from(">HHIH", data, at)
            at += 10
            if at + size > len(data):
                raise ValueError("an answer is cut off")
            body = data[at : at + size]
            if kind == 1 and size == 4:
                value = ".".join(map(str, body))
            elif kind == 28 and size == 16:
                value = ":".join(f"{x:x}" for x in struct.unpack(">8H", body))
            elif kind in (2, 5, 12):
                value = _name(data, at)[0]
            else:
                value = body.decode("utf-8", "replace")
            answers.append({"rrname": name, "rtype": QTYPES.get(kind, "OTHER"), "ttl": ttl, "rdata": value})
            at += size
    except (struct.error, IndexError, ValueError, TypeError):
        return None
    rcode = flags & 15
    return {"transaction_id": ident, "is_response": bool(flags >> 15), "rcode": rcode, "rcode_name": RCODES.get(rcode, "OTHER"), "questions": questions, "answers": answers}


def _codes(data: bytes) -> list[int]:
    return list(struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2]))


def client_hello(data: bytes | None) -> dict | None:
    """The ClientHello at the start of a TLS record on any port; None if there is none or it is cut off."""
    try:
        if data[0] != 0x16 or data[5] != 1:
            return None
        end = 9 + int.from_bytes(data[6:9], "big")
        if end > len(data):
            return None

        def take(at: int, width: int) -> tuple[bytes, int]:
            n = int.from_bytes(data[at : at + width], "big")
            stop = at + width + n
            if stop > end:
                raise ValueError("a field is cut off")
            return data[at + width : stop], stop

        out = {"legacy_version": struct.unpack_from(">H", data, 9)[0], "extensions": [], "supported_groups": [], "ec_point_formats": [], "signature_algorithms": [], "supported_versions": [], "sni": None, "alpn_protocols": []}
        _, at = take(43, 1)
        ciphers, at = take(at, 2)
        _, at = take(at, 1)
        out["ciphers"] = _codes(ciphers)
        extensions = take(at, 2)[0] if at < end else b""
        at = 0
        while at + 4 <= len(extensions):
            kind, size = struct.unpack_from(">HH", extensions, at)
            body = extensions[at + 4 : at + 4 + size]
            if len(body) < size:
                raise ValueError("an extension is cut off")
            at += 4 + size
            out["extensions"].append(kind)
            if kind == 0 and size > 5:
                out["sni"] = body[5 : 5 + int.from_bytes(body[3:5], "big")].decode("utf-8", "replace")
            elif kind == 10:
                out["supported_groups"] = _codes(body[2:])
            elif kind == 11:
                out["ec_point_formats"] = list(body[1:])
            elif kind == 13:
                out["signature_algorithms"] = _codes(body[2:])
            elif kind == 43:
                out["supported_versions"] = _codes(body[1:])
            elif kind == 16:
                i = 2
                while i < size:
                    out["alpn_protocols"].append(body[i + 1 : i + 1 + body[i]])
                    i += 1 + body[i]
    except (struct.error, IndexError, ValueError, TypeError):
        return None
    return out


def _parsed(parse, schema: str):
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(f"valid boolean, {schema}")
    def run(raw: pd.Series) -> pd.DataFrame:
        rows = [parse(x) for x in raw]
        return pd.DataFrame({"valid": [r is not None for r in rows]} | {n: pd.Series([None if r is None else r[n] for r in rows], dtype=object) for n in names})

    return run


def _or_null(parsed: Column) -> Column:
    return F.when(parsed["valid"], parsed)


def parse_packet(raw: Column) -> Column:
    """struct of a packet's fields and payload; null for what is not IPv4. One pass over the bytes for all layers."""
    return _or_null(_parsed(packet, PACKET)(raw))


def parse_dns(payload: Column) -> Column:
    return _or_null(_parsed(dns, DNS)(payload))


def parse_client_hello(payload: Column) -> Column:
    return _or_null(_parsed(client_hello, HELLO)(payload))
