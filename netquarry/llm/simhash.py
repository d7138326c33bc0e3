"""Near-duplicates by SimHash fingerprints, joined exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, column
from .components import components, local_roots
from .store import free, saved

LEAF = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 (seed 42) of the text's word shingles.

    Words are runs without ASCII white space, A-Z in lower case. With fewer words than ``shingle`` the whole
    sequence is the only shingle; without words (or text) the fingerprint is zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, 42)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    n = len(words) - shingle + 1
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([hashed(joined[i:j], 42) for i, j in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            values = np.array([fingerprint(t, shingle) for t in column(batch, "text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return run


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def split(points: np.ndarray, radius: int, tries: int = 3) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance t: the inside has d <= t, the outside d > t - radius.

    By the triangle inequality two points within ``radius`` of each other differ by at most that in their
    distance to the vantage point; so each such pair is inside together or outside together. None if no try
    gets both parts below 0.9 of the points.
    """
    best = None
    for k in range(tries):
        vantage = points[(len(points) - 1) * k // max(1, tries - 1)]
        seen = np.bincount(distance(points, vantage), minlength=65).cumsum()
        for t in {int(np.searchsorted(seen, len(points) * share)) for share in (0.4, 0.5, 0.6)}:
            if t >= 64:
                continue
            inside, outside = seen[t], len(points) - (seen[t - radius] if t >= radius else 0)
            worst = max(inside, outside)
            if inside < len(points) and (best is None or worst < best[0]):
                best = (worst, vantage, t)
    return best[1:] if best and best[0] < 0.9 * len(points) else None


class VantageTree:
    """The top of a vantage-point tree; its leaves are shards."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int):
        self.radius, self.nodes, self.shards = radius, [], 0
        todo = [(sample, None, 0)]
        while todo:
            points, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][2 + side] = at
            cut = split(points, radius) if len(points) > leaf else None
            if cut is None:
                self.nodes.append([None, self.shards, 0, 0])
                self.shards += 1
                continue
            self.nodes.append([cut[0], cut[1], 0, 0])
            d = distance(points, cut[0])
            todo += [(points[d <= cut[1]], at, 0), (points[d > cut[1] - radius], at, 1)]

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, rows of ``points`` in it); a point near a border goes to both sides."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            vantage, t, inside, outside = self.nodes[at]
            if not len(rows):
                continue
            if vantage is None:
                yield t, rows
                continue
            d = distance(points[rows], vantage).astype(np.int16)
            todo += [(inside, rows[d <= t]), (outside, rows[d > t - self.radius])]


def _ball_links(points: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between points so close together that no vantage point divides them: two are within 2 exactly
    if they have a neighbour at distance 0 or 1 in common, so equal neighbours in order link all of them."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    if radius != 2:
        flips = flips[:0]
    passes, a, b = max(1, len(rows) * 65 // (1 << 22)), [], []
    for part in range(passes):
        near, owner = [], []
        for flip in flips:
            x = points[rows] ^ flip
            keep = x % np.uint64(passes) == part if passes > 1 else slice(None)
            near.append(x[keep])
            owner.append(rows[keep])
        near, owner = np.concatenate(near), np.concatenate(owner)
        order = np.argsort(near, kind="stable")
        near, owner = near[order], owner[order]
        same = np.flatnonzero(near[1:] == near[:-1])
        a.append(owner[same])
        b.append(owner[same + 1])
    return np.concatenate(a), np.concatenate(b)


def shard_roots(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct points, the first one that it reaches over links of at most ``radius`` bits.

    Goes on splitting around vantage points down to leaves, which compare all pairs.
    """
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held, root, todo = 0, np.arange(len(points)), [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            p = points[rows]
            i, j = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= radius, 1))
            x, y = rows[i], rows[j]
        elif cut := split(points[rows], radius):
            d = distance(points[rows], cut[0]).astype(np.int16)
            todo += [rows[d <= cut[1]], rows[d > cut[1] - radius]]
            continue
        elif radius == 2:
            x, y = _ball_links(points, rows, radius)
        else:
            near = [(r, k) for r in range(len(rows)) for k in [rows[np.bitwise_count(points[rows] ^ points[rows[r]]) <= radius]]]
            x, y = np.concatenate([np.full(len(k), rows[r]) for r, k in near]), np.concatenate([k for _, k in near])
        a.append(x)
        b.append(y)
        held += len(x)
        if held > 1 << 20:  # what is known so far, as one link for each point
            root = local_roots(len(points), np.concatenate([*a, np.arange(len(points))]), np.concatenate([*b, root]))
            a, b, held = [], [], 0
    return local_roots(len(points), np.concatenate([*a, np.arange(len(points))]), np.concatenate([*b, root]))


def _route(tree: VantageTree):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = column(batch, "fp").to_numpy()
            for shard, rows in tree.route(points.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, dtype=np.int32)), pa.array(points[rows])], names=["shard", "fp"])

    return run


def _shard_edges(radius: int):
    def run(table: pa.Table) -> pa.Table:
        points = np.unique(table["fp"].to_numpy())
        root = shard_roots(points.view(np.uint64), radius)
        moved = np.flatnonzero(root != np.arange(len(points)))
        return pa.table({"a": points[moved], "b": points[root[moved]]})

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): see :func:`fingerprint`; fp as a signed long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def links(distinct: DataFrame, n: int, radius: int = 2, shard_rows: int = 4096, sample_rows: int = 1 << 21) -> DataFrame:
    """(a, b) edges that connect exactly the fingerprints which a chain of links of at most ``radius`` bits
    connects. ``distinct`` has ``n`` different values of fp.

    The top of the tree is built from a sample by hash, of 256 fingerprints for each shard of about
    ``shard_rows`` or as many as ``sample_rows`` leaves each, 32 at least; only this sample (16 MB at most) goes to the driver. So the number of
    shards grows with the corpus and their size does not, up to 65,536 shards; beyond, shards grow, in memory by 8 bytes a fingerprint, and go on splitting
    inside their tasks. Every fingerprint is routed to its shard, and to those across a border closer than the radius. A shard returns one edge
    for a fingerprint at most, to the first of its group there, however many pairs the group has.
    """
    shards = min(-(-n // shard_rows), sample_rows // 32)
    rate = max(1, n // max(1, min(sample_rows, 256 * shards)))
    found = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(rate)) == 0).select("fp").limit(2 * sample_rows).toArrow()
    sample = np.sort(found["fp"].to_numpy().astype(np.int64))
    sample = np.random.default_rng(7).permutation(sample)
    tree = VantageTree(sample.view(np.uint64), max(2, len(sample) // max(1, shards)), radius)
    routed = distinct.select("fp").mapInArrow(_route(tree), "shard int, fp long")
    return routed.groupBy("shard").applyInArrow(_shard_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, shard_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; component_id is the smallest doc_id that a
    document reaches over links, its own included. All links count: copies are joined through their common
    fingerprint, different fingerprints by an exact search in shards of about ``shard_rows``.

    ``docs`` needs doc_id and text; other columns are ignored whatever their names. A null, empty or blank text
    has fingerprint zero and is linked like any other. Repeated rows return each. A null doc_id keeps its row; it
    is never the smallest, and component_id is null only where all reachable ids are. An empty table gives no rows.
    """
    marked = saved(fingerprints(docs, shingle), "fingerprints")
    groups = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    n = groups.count()
    roots = components(links(groups, n, radius, shard_rows)) if n > 1 else None
    if roots is None:
        labels = groups.select("fp", F.col("first").alias("component_id"))
    else:
        roots = saved(roots, "roots")
        linked = groups.join(roots, groups.fp == roots.node).select("fp", "first", "root")
        least = linked.groupBy("root").agg(F.min("first").alias("least"))
        joined = linked.join(least, "root").select(F.col("fp").alias("node"), "least")
        labels = groups.join(joined, groups.fp == joined.node, "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    labels = saved(labels.select(F.col("fp").alias("label_fp"), "component_id"), "labels")
    return marked.join(labels, marked.fp == labels.label_fp, "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is its component's, one row for each id.

    A document without an id has one made of its text's hash, over 2^62, so that real ids go before it. Ids that grow with
    the corpus are never broadcast: the join shuffles by id at every size.
    """
    made = F.pmod(F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))), F.lit(1 << 61)) + F.lit(1 << 62)
    own = F.coalesce(docs["doc_id"].cast("long"), made)
    kept, once = free(docs, "kept_id"), free(docs, "kept_once")
    found = saved(near_duplicates(docs.select(own.alias("doc_id"), docs["text"]), radius, shingle), "components")
    keep = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(kept)).count()
    keep = saved(keep, "kept")
    rows = docs.join(keep.select(kept).hint("merge"), own == F.col(kept), "left_semi")
    if keep.where("count > 1").isEmpty():
        return rows
    return rows.withColumn(once, own).dropDuplicates([once]).drop(once)
