"""Packing documents' tokens into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, column
from .tokens import word_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; the pieces come longest first.

    A tournament tree holds the free room of the bins at its leaves and the larger of two children above
    them, so the first bin with room is found by one walk down from the root.
    """
    leaves = 1
    while leaves < 2 * -(-sum(lengths) // capacity) + 1:
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < length:
                at += 1
        bins.append(at - leaves)
        offsets.append(capacity - room[at])
        room[at] -= length
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece when every document is cut into full sequences and a rest."""
    n = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
    return doc, start, np.minimum(capacity, lengths[doc] - start)


def _pieces(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(path), Counter()
        for batch in by_bytes(batches):
            ids, starts = encoder.ids(column(batch, "text"), end=True)
            raw, sizes = memoryview(ids).cast("B"), np.diff(starts)
            doc, start, length = cut(sizes, capacity)
            at = starts[doc] + start
            crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
            again = []  # tells repeated rows apart, so that they can go to different groups
            for key in zip(column(batch, "doc_id").to_pylist(), sizes.tolist(), (crc[k] for k in np.flatnonzero(start == 0).tolist()), strict=True):
                seen[key] += 1
                again.append(seen[key])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(np.array(again, dtype=np.int64)[doc])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "again"],
            )

    return run


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        full = int((lengths == capacity).sum())  # a full piece is a sequence of its own
        bins, offsets = first_fit_decreasing(lengths[full:].tolist(), capacity)
        bins = np.concatenate([np.arange(full), full + np.array(bins, dtype=np.int64)])
        group = table["grp"].to_numpy().astype(np.int64)
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        out = out.append_column("sequence_id", pa.array((group << 32) + bins))
        return out.append_column("offset", pa.array(np.concatenate([np.zeros(full, dtype=np.int64), np.array(offsets, dtype=np.int64)])))

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, group_rows: int = 2048, groups: int | None = None) -> DataFrame:
    """One row per piece of a document: where it starts there, its length and crc32, and its place in a sequence.

    Each document is its ids and the end id; it is cut into full sequences and a rest. Rests are packed by
    first-fit decreasing, independently in groups to which a hash deals the pieces at random, about
    ``group_rows`` documents to a group, so a task's memory does not depend on the corpus. Only the pieces'
    descriptions are shuffled, never texts or ids.

    ``docs`` needs doc_id and text; other columns are ignored whatever their names. A null text is empty; an
    empty text is one piece of the end id alone. Rows with a null doc_id are packed like others; repeated rows
    are packed each time, dealt apart by their count. An empty table gives no rows. A text of any length is
    processed whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if groups is None:
        groups = max(1, -(-docs.count() // group_rows))
    pieces = docs.mapInArrow(_pieces(vocabulary, capacity), PIECES + ", again long")
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "again"), F.lit(groups)).cast("int")).drop("again")
    return dealt.groupBy("grp").applyInArrow(_pack_group(capacity), PACKED)
