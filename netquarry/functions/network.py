"""Flow keys, ratios and DNS codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of DNS record types and response codes (RFC 1035 and extensions).
QTYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}


def named(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("OTHER"))


def qtype_name(code: Column) -> Column:
    return named(code, QTYPES)


def rcode_name(code: Column) -> Column:
    return named(code, RCODES)


def is_forward(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """Whether the packet goes from the canonical key's source: the smaller (address text, port) end."""
    return F.struct(src_ip.alias("ip"), F.coalesce(src_port, F.lit(0)).alias("port")) <= F.struct(dst_ip.alias("ip"), F.coalesce(dst_port, F.lit(0)).alias("port"))


def flow_id(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    return F.concat(src_ip, F.lit(":"), src_port.cast("string"), F.lit("-"), dst_ip, F.lit(":"), dst_port.cast("string"), F.lit("-"), protocol)


def ratio(part: Column, whole: Column, default: float) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(default))


def stable_id(*parts: Column) -> Column:
    """12 hex digits that depend on the content alone, so a replay gives the same id."""
    return F.substr(F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256), F.lit(1), F.lit(12))
