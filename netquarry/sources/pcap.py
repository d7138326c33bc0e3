"""Packet capture files as a batch and streaming source: ``spark.read.format("pcap").load(path)``.

Columns: ts_us (capture time), raw. Options: path (a file, folder or pattern on storage that executors share), limit (packets
of each file). A file is a partition and is read record by record, so memory does not grow with it. Both formats are read: pcap, which
counts 32 bits of seconds from 1970 on (to 2106), and pcapng, which holds any time, and packets without one (ts_us is null).
"""

from __future__ import annotations

import contextlib
import glob
import itertools
import os
import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "ts_us bigint, raw binary"
#: Magic numbers of the format, with byte order and fractions of a second.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000)}
#: Fixed values of pcapng: types of its blocks, a section's byte order, options of an interface.
SECTION, INTERFACE, OLD_PACKET, SIMPLE, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
ORDERS = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}
RESOLUTION, OFFSET = 9, 14
#: The first time past those of pcap, and the seconds that pcapng's times before 1970 count from.
END, EARLY = 1_000_000 << 32, -(1 << 63) // 1_000_000


def read_file(path: str, limit: int | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(microseconds, bytes) of each packet; a cut-off record ends the file, another format raises."""
    with open(path, "rb") as f:
        head = f.read(24)
        if head[:4] == struct.pack("<I", SECTION) and head[8:12] in ORDERS:
            f.seek(0)
            yield from itertools.islice(_blocks(f, path), limit)
            return
        if head[:4] not in MAGIC or len(head) < 24:
            raise ValueError(f"{path} is no packet capture")
        order, parts = MAGIC[head[:4]]
        n = 0
        while limit is None or n < limit:
            record = f.read(16)
            if len(record) < 16:
                return
            seconds, fraction, size, _ = struct.unpack(order + "IIII", record)
            raw = f.read(size)
            if len(raw) < size:
                return
            yield seconds * 1_000_000 + fraction * 1_000_000 // parts, raw
            n += 1


def _blocks(f: BinaryIO, path: str) -> Iterator[tuple[int | None, bytes]]:
    """The same of a pcapng file; blocks of other kinds are passed over."""
    order, interfaces = "<", []
    while len(head := f.read(12)) == 12:
        if head[:4] == struct.pack("<I", SECTION):  # the same in both orders
            if head[8:] not in ORDERS:
                raise ValueError(f"{path} has a section without byte order")
            order, interfaces = ORDERS[head[8:]], []
        kind, size = struct.unpack(order + "II", head[:8])
        if size < 12 or size % 4:
            raise ValueError(f"{path} has a block of {size} bytes")
        body = head[8:] + f.read(size - 12)
        if len(body) < size - 8:
            return
        body = body[:-4]
        if kind == INTERFACE:
            interfaces.append((*_clock(body, order), struct.unpack_from(order + "I", body, 4)[0]))
        elif kind in (PACKET, OLD_PACKET):
            at, high, low, n, _ = struct.unpack_from(order + ("I4I" if kind == PACKET else "H2x4I"), body)
            parts, offset, _ = interfaces[at]
            yield offset * 1_000_000 + (high << 32 | low) * 1_000_000 // parts, body[20 : 20 + n]
        elif kind == SIMPLE:
            n, most = struct.unpack_from(order + "I", body)[0], interfaces[0][2]
            yield None, body[4 : 4 + (min(n, most) if most else n)]


def _clock(body: bytes, order: str) -> tuple[int, int]:
    """Parts of a second that an interface counts in, and the second that it counts from."""
    parts, offset, at = 1_000_000, 0, 8
    while at + 4 <= len(body):
        code, n = struct.unpack_from(order + "HH", body, at)
        if code == RESOLUTION and n == 1:
            parts = 2 ** (body[at + 4] & 127) if body[at + 4] & 128 else 10 ** body[at + 4]
        elif code == OFFSET and n == 8:
            offset = struct.unpack_from(order + "q", body, at + 4)[0]
        elif code == 0:
            break
        at += 4 + n + -n % 4
    return parts, offset


def _record(us: int, raw: bytes) -> bytes:
    return struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(raw), len(raw)) + raw


def _block(kind: int, body: bytes) -> bytes:
    size = 12 + len(body) + -len(body) % 4
    return struct.pack("<II", kind, size) + body.ljust(size - 12, b"\0") + struct.pack("<I", size)


def _packet_block(us: int | None, raw: bytes) -> bytes:
    if us is None:
        return _block(SIMPLE, struct.pack("<I", len(raw)) + raw)
    early = us < 0
    since = us - EARLY * 1_000_000 if early else us
    return _block(PACKET, struct.pack("<5I", early, since >> 32, since & 0xFFFFFFFF, len(raw), len(raw)) + raw)


#: What each format's file begins with, and its records. In pcapng, the second interface is for times before 1970; neither bounds a packet.
FORMATS = {
    "pcap": (struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, 101), _record),
    "pcapng": (
        _block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + _block(INTERFACE, struct.pack("<HHI", 101, 0, 0)) + _block(INTERFACE, struct.pack("<HHIHHqHH", 101, 0, 0, OFFSET, 8, EARLY, 0, 0)),
        _packet_block,
    ),
}


def file_bytes(packets: Iterable[tuple[int | None, bytes]], kind: str = "pcap") -> Iterator[bytes]:
    head, record = FORMATS[kind]
    yield head
    for us, raw in packets:
        yield record(us, raw)


def write_files(name: str, packets: Iterable[tuple[int | None, bytes]]) -> list[str]:
    """Writes packets to ``name``.pcap.tmp, and those whose time that can't hold to ``name``.pcapng.tmp; returns the files there are, without .tmp."""
    out: dict[str, BinaryIO] = {}
    with contextlib.ExitStack() as stack:
        for us, raw in packets:
            kind = "pcap" if us is not None and 0 <= us < END else "pcapng"
            if kind not in out:
                out[kind] = stack.enter_context(open(f"{name}.{kind}.tmp", "wb"))
                out[kind].write(FORMATS[kind][0])
            out[kind].write(FORMATS[kind][1](us, raw))
    return [f"{name}.{kind}" for kind in out]


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted([f for kind in FORMATS for f in glob.glob(os.path.join(glob.escape(path), f"*.{kind}"))] if os.path.isdir(path) else glob.glob(path))


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in files(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_file(partition.value, self.limit) if partition.value else ()


class PcapStream(DataSourceStreamReader):
    """New files of a folder, in whatever order they arrive; executors read them, a file to a task.

    An offset is the list of the files there are, so one that comes late under an earlier name is read once, and none twice. Files that
    were read may be moved away; the folder's size bounds an offset's.
    """

    def __init__(self, options: dict):
        self.reader = PcapReader(options)

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": files(self.reader.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        seen = set(start["files"])
        return [InputPartition(p) for p in end["files"] if p not in seen]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.reader.read(partition)


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcapReader:
        return PcapReader(self.options)

    def streamReader(self, schema) -> PcapStream:
        return PcapStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
