"""Token ids in files of independent zstandard frames with a seek table at the end.

A file is: data frames; one skippable frame with the index of its documents; and the seek table of the
Zstandard Seekable Format, itself a skippable frame, with each frame's compressed and decompressed size and
checksum (the low 32 bits of XXH64 of the decompressed bytes). Any zstandard reader can read it through.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch_path
from .batches import by_bytes, column
from .store import saved
from .tokens import word_ids

SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
INDEX_HEAD = struct.Struct("<4sBxxxQ")  # magic, bytes of an id, documents
INDEX_MAGIC = b"TIDX"
FRAME_BYTES = 1 << 18
LEAST = -(2**63)


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if ":/" in uri else (pyarrow.fs.LocalFileSystem(), uri)


class Writer:
    """Writes documents' ids to a stream; holds one frame and the index in memory."""

    def __init__(self, out, width: int, level: int = 3):
        self.out, self.width, self.packer = out, width, zstandard.ZstdCompressor(level=level)
        self.pending, self.held, self.table = [], 0, []
        self.ids, self.counts = [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(raw) // self.width)
        for at in range(0, len(raw), FRAME_BYTES):  # a longer document spans frames
            self.pending.append(raw[at : at + FRAME_BYTES])
            self.held += len(self.pending[-1])
            if self.held >= FRAME_BYTES:
                self._frame()

    def _frame(self) -> None:
        data = b"".join(self.pending)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        if self.held:
            self._frame()
        known = np.array([x is not None for x in self.ids], dtype=np.uint8)
        ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        body = self.packer.compress(known.tobytes() + ids.tobytes() + np.array(self.counts, dtype="<i8").tobytes())
        index = INDEX_HEAD.pack(INDEX_MAGIC, self.width, len(self.ids)) + body
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(entries) + len(foot)) + entries + foot)
        return len(self.ids), sum(self.counts)


class Reader:
    """Reads documents by their place in the file, decompressing only the frames that hold them."""

    def __init__(self, source):
        self.source, self.unpacker, size = source, zstandard.ZstdDecompressor(), source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.table, starts = table[:-1], np.concatenate([[0], table[:, 0].cumsum()])
        self.frame_at, self.byte_at = starts, np.concatenate([[0], self.table[:, 1].cumsum()])
        index = self._at(int(starts[n - 1]) + 8, int(table[-1, 0]) - 8)
        self._checked(index, int(table[-1, 2]))
        magic, self.width, docs = INDEX_HEAD.unpack(index[: INDEX_HEAD.size])
        body = self.unpacker.decompress(index[INDEX_HEAD.size :])
        if magic != INDEX_MAGIC or len(body) != 17 * docs:
            raise ValueError("not an index of documents")
        known = np.frombuffer(body[:docs], dtype=np.uint8).astype(bool)
        ids = np.frombuffer(body[docs : 9 * docs], dtype="<i8")
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(body[9 * docs :], dtype="<i8")
        self.starts = self.counts.cumsum() - self.counts
        self.last = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    @staticmethod
    def _checked(data: bytes, checksum: int) -> bytes:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError("a frame's checksum is wrong")
        return data

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed = self._at(int(self.frame_at[k]), int(self.table[k, 0]))
            data = self.unpacker.decompress(packed, max_output_size=int(self.table[k, 1]))
            self.last = (k, self._checked(data, int(self.table[k, 2])))
        return self.last[1]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's ``k``-th document as unsigned 32-bit integers."""
        start, stop = self.width * int(self.starts[k]), self.width * int(self.starts[k] + self.counts[k])
        parts, f = [], int(np.searchsorted(self.byte_at, start, side="right")) - 1
        while start < stop:
            base = int(self.byte_at[f])
            part = self.frame(f)[start - base : stop - base]
            parts.append(part)
            start += len(part)
            f += 1
        return np.frombuffer(b"".join(parts), dtype=f"<u{self.width}").astype("<u4")


def _encode(path: str, bounds: np.ndarray, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(path), Counter()
        for batch in by_bytes(batches):
            ids, starts = encoder.ids(column(batch, "text"), end=True)
            owner = column(batch, "doc_id")
            values = owner.fill_null(LEAST).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, values, "left"), np.searchsorted(bounds, values, "right")
            again = []  # an id that fills several files is dealt over them
            for x in values.tolist():
                again.append(seen[x])
                seen[x] += 1
            if len(seen) > 1 << 17:
                seen = Counter({x: n for x, n in seen.items() if n > 1})
            file = low + np.array(again, dtype=np.int64) % (high - low + 1)
            raw = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * width), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([pa.array(file.astype(np.int32)), owner, raw.cast(pa.binary())], names=["file", "doc_id", "ids"])

    return run


def _write(folder: str, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        file, name, writer, out = None, "", None, None

        def done():
            n, total = writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "name": pa.array([name]), "docs": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

        for batch in by_bytes(batches, "ids"):
            for f, doc_id, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if f != file:
                    if writer:
                        yield done()
                    file, name = f, f"part-{f:08d}-{uuid.uuid4().hex}.zst"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)  # the frames are compressed already
                    writer = Writer(out, width)
                writer.add(doc_id, raw)
        if writer:
            yield done()

    return run


def write(docs: DataFrame, vocabulary: str, folder: str, file_rows: int = 8192, most_files: int = 10_000) -> DataFrame:
    """Writes every document's ids and end id in ascending order of doc_id; returns file, name, docs, ids of each file.

    Bounds of the files come from approximate quantiles of doc_id, ``most_files`` at most; each task tokenises,
    the ids (two bytes each if the vocabulary allows) are shuffled to their file, sorted, and streamed out. Every attempt of a task writes
    under a name of its own, and the returned table, which Spark commits once for each task, names the files that count; so a task
    can be run again on any store, without a rename, and what lost attempts left is deleted at the end.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text is the end id alone; null ids come
    first; repeated rows are written each, an id (or null) that fills more than a file over several. An empty table
    writes no file.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    files = min(most_files, -(-n // file_rows)) if n else 1
    cuts = [i / files for i in range(1, files)]
    order = F.coalesce("doc_id", F.lit(LEAST))
    found = docs.agg(F.percentile_approx(order, F.array(*map(F.lit, cuts)), 20 * most_files)).first()[0] if cuts else []
    bounds = np.sort(np.array(found or [], dtype=np.int64))
    width = 2 if word_ids(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else 4
    encoded = docs.mapInArrow(_encode(vocabulary, bounds, width), "file int, doc_id long, ids binary")
    dealt = encoded.repartitionById(files, F.col("file")).sortWithinPartitions("file", F.asc_nulls_first("doc_id"), F.crc32("ids"))
    written = saved(dealt.mapInArrow(_write(folder, width), "file int, name string, docs long, ids long"), "files")
    store, base = open_fs(folder)
    if store.get_file_info(base).type == pyarrow.fs.FileType.Directory:
        named = {r.name for r in written.select("name").collect()}
        for info in store.get_file_info(pyarrow.fs.FileSelector(base)):
            if info.base_name not in named:
                store.delete_file(info.path)
    return written


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files.

    What is known of the files (one row each, a bounded number) gives each file's first place; the documents
    themselves are read by the executors, a file to a task.
    """
    known = sorted(tuple(r) for r in files.select("file", "name", "docs", "ids").collect())
    first, at = [], 0
    for _, name, _, ids in known:
        first.append((name, at))
        at += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not first:
        return spark.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as source:
                    reader = Reader(source)
                    crc = [zlib.crc32(reader.document(k)) for k in range(len(reader.counts))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, pa.int64()), pa.array(reader.starts + before), pa.array(reader.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    places = spark.createDataFrame(first, "name string, before long").repartition(len(first), "name")
    return places.mapInArrow(run, schema)


def written_and_read(docs: DataFrame, vocabulary: str, file_rows: int = 8192) -> DataFrame:
    """The documents as read back from files in the shared folder."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read(docs.sparkSession, folder, write(docs, vocabulary, folder, file_rows))
