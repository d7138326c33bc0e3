"""The near-copy stage: classes of the SimHash operator, and what two bits cannot see, confirmed by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, column
from .components import components
from .simhash import near_duplicates
from .store import free, saved

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.999995 at 0.8.
BANDS, ROWS = 40, 6
_rng = np.random.default_rng(42)
_A = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the different word shingles, in order; words as in :func:`netquarry.llm.simhash.fingerprint`.

    With fewer words than ``shingle`` the whole sequence is the only one; without words there are none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = xxhash.xxh64_intdigest
    w = np.fromiter((hashed(x, 42) for x in words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(w))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = _mixed(h * _P + w[j : j + len(h)])
    return np.unique(h)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of minima; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        m = x[None, at : at + 1024] * _A
        m += _B
        np.minimum(least, m.min(axis=1), out=least)
    rows, key = least.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key * _P + rows[:, j])
    return key


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def _signed(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            ids, keys = [], []
            for t in column(batch, "text").to_pylist():
                h = shingles(t, shingle)
                ids.append(_set_id(h))
                keys.append(bands(h).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([column(batch, "own"), column(batch, "th"), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), listed], names=["own", "th", "node", "bands"])

    return run


def linked_labels(sets: list[np.ndarray], labels: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between labels that pairs of sets with a similarity of at least ``part`` / ``whole`` connect, one for a label at most.

    Sets of one label are known to be connected. Every other pair is compared by its exact overlap, unless what was found
    before connects the two or their sizes rule it out.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    names, of = np.unique(np.asarray(labels)[order], return_inverse=True)
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    by_label = np.argsort(of, kind="stable")
    first = np.searchsorted(of[by_label], np.arange(len(names) + 1))
    members = lambda label: by_label[first[label] : first[label + 1]].tolist()
    mark, reached = np.zeros(int(codes.max()) + 1, dtype=bool), np.zeros(len(names), dtype=bool)
    left, flat, at, a, b = np.arange(len(sizes)), codes, ends, [], []
    for seed in range(len(names)):
        if reached[seed]:
            continue
        reached[seed], queue, gone = True, members(seed), of[left] == seed
        while True:
            if gone.any():
                flat, left = flat[np.repeat(~gone, sizes[left])], left[~gone]
                at = np.concatenate([[0], np.cumsum(sizes[left])])
            gone = np.zeros(len(left), dtype=bool)
            if not queue or not len(left):
                break
            v, n = queue.pop(), sizes[left]
            low, high = np.searchsorted(n * whole, part * sizes[v]), np.searchsorted(n * part, whole * sizes[v], side="right")
            if low >= high:
                continue
            mine = codes[ends[v] : ends[v + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat[at[low] : at[high]]], at[low:high] - at[low], dtype=np.int64)
            mark[mine] = False
            near = np.unique(of[left[low:high][both * whole >= part * (sizes[v] + n[low:high] - both)]])
            for label in near.tolist():
                reached[label] = True
                a.append(label)
                b.append(seed)
                queue += members(label)
            if len(near):
                gone = reached[of[left]]
    return names[np.array(a, dtype=np.int64)], names[np.array(b, dtype=np.int64)]


def _sets(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [shingles(t, shingle).view(np.int64) for t in column(batch, "text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["node", "hashes"])

    return run


def _compared(part: int, whole: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [x.values.to_numpy().view(np.uint64) for x in table["hashes"]]
        a, b = linked_labels(sets, table["label"].to_numpy(), part, whole)
        return pa.table({"a": a, "b": b})

    return run


def _star_links(members: DataFrame, sets: DataFrame, part: int, whole: int, rows: int = 4096) -> DataFrame:
    """(a, b): members of a bucket that are similar enough to its least node. A node that is the least of very many is copied for
    every ``rows`` of them, so that no task compares them all."""
    parts = lambda n: F.ceil(n / rows).cast("int")
    pairs = saved(members.where("node <> least").groupBy("node", "least").agg(F.max("n").alias("n")), "pairs")
    one = sets.select(F.col("node").alias("least"), F.col("hashes").alias("theirs"))
    centres = pairs.groupBy("least").agg(F.max("n").alias("n")).join(one.hint("merge"), "least").select("least", "theirs", F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)).alias("salt"))
    mine = pairs.join(sets.hint("merge"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), parts(F.col("n"))).cast("int"))
    both = mine.join(centres.hint("merge"), ["least", "salt"]).withColumn("both", F.size(F.array_intersect("hashes", "theirs")))
    return both.where(F.col("both") * whole >= part * (F.size("hashes") + F.size("theirs") - F.col("both"))).select(F.col("node").alias("a"), F.col("least").alias("b"))


def _open_links(open_: DataFrame, sets: DataFrame, part: int, whole: int, block_rows: int, block_hashes: int) -> DataFrame:
    """(a, b) between labels: links within what open buckets (key, node, label) connect, every pair of different labels compared.

    What is connected is cut into blocks of bounded size, a label that fills more than one into blocks of its own; each pair of blocks
    is compared in one task, except two of the same label.
    """
    stars = open_.groupBy("key").agg(F.min("node").alias("b")).join(open_.hint("merge"), "key").select(F.col("node").alias("a"), "b")
    roots = components(stars).select(F.col("node"), "root")
    nodes = open_.select("node", "label").distinct().join(roots.hint("merge"), "node").join(sets.select("node", F.size("hashes").alias("w")).hint("merge"), "node")
    nodes = saved(nodes, "open")
    fills = F.greatest(F.count("*") / block_rows, F.sum("w") / block_hashes)
    sizes = nodes.groupBy("root", "label").agg(fills.alias("fill"))
    sizes = saved(sizes.withColumn("sole", F.when(F.col("fill") > 1, F.col("label"))), "fills")
    small = sizes.where("sole IS NULL").groupBy("root").agg(F.ceil(F.sum("fill")).cast("long").alias("parts"))
    dealt = nodes.join(sizes.hint("merge"), ["root", "label"]).join(small.hint("merge"), "root", "left")
    own = F.pmod(F.xxhash64("node"), F.ceil("fill").cast("long"))
    shared = F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), "parts"))
    placed = saved(dealt.select("root", "node", "label", "sole", F.when(F.col("sole").isNotNull(), own).otherwise(shared).alias("block")), "blocks")
    blocks = placed.select("root", "sole", "block").distinct()
    left, right = blocks.where("sole IS NULL").select("root", F.lit(None).cast("long").alias("s1"), F.col("block").alias("b1")), blocks.select("root", F.col("sole").alias("s2"), F.col("block").alias("b2"))
    pairs = left.join(right, "root").where("s2 IS NOT NULL OR b1 <= b2")
    large = sizes.where("sole IS NOT NULL")
    labels = large.select("root", F.col("sole").alias("s1")).join(large.select("root", F.col("sole").alias("s2")), "root").where("s1 < s2")
    of = lambda s, b: blocks.where("sole IS NOT NULL").select("root", F.col("sole").alias(s), F.col("block").alias(b))
    pairs = pairs.unionByName(labels.join(of("s1", "b1"), ["root", "s1"]).join(of("s2", "b2"), ["root", "s2"]).select("root", "s1", "b1", "s2", "b2"))
    pairs = saved(pairs.withColumn("pair", F.struct("root", "s1", "b1", "s2", "b2")), "block_pairs")
    ends = pairs.select("pair", "root", F.col("s1").alias("s"), F.col("b1").alias("block")).unionByName(pairs.select("pair", "root", F.col("s2").alias("s"), F.col("b2").alias("block"))).distinct()
    met = placed.join(ends, (placed["root"] == ends["root"]) & placed["sole"].eqNullSafe(ends["s"]) & (placed["block"] == ends["block"])).select("pair", "node", "label")
    full = met.join(sets.hint("merge"), "node").select(F.xxhash64("pair").alias("pair"), "label", "hashes")
    return full.groupBy("pair").applyInArrow(_compared(part, whole), "a long, b long")


def keep_first(docs: DataFrame, shingle: int = 5, part: int = 4, whole: int = 5, block_rows: int = 2048, block_hashes: int = 1 << 19) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their group of near copies, by doc_id and then by a hash of the text.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle`` words is at least ``part`` / ``whole``; groups
    are what links connect. Candidates come from the SimHash operator, whose classes (:func:`simhash.near_duplicates` with these shingles)
    hold what differs little, and from 40 bands of six minima for what differs more. Both are buckets of texts; every link is
    confirmed by exact overlap: each member of a bucket is held against its least one, then, where a bucket still holds
    members that no link connects, all pairs of those are compared, in blocks of at most ``block_rows`` texts or ``block_hashes`` shingles. So
    no task holds a whole group, however large, and groups of copies cost time in proportion to their size.

    ``docs`` needs doc_id and text; other columns stay. Null, empty and blank texts are one group. A document without an id comes
    after all with one, in order of its text's hash. Equal rows of id and text stay once; rows with the same id and other texts
    are documents of their own. Ids that grow with the corpus are never broadcast. An empty table gives no rows.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    th = F.xxhash64(text)
    own = F.coalesce(docs["doc_id"].cast("long"), F.pmod(th, F.lit(1 << 61)) + F.lit(1 << 62))
    kept_id, kept_th, once, once_th = (free(docs, c) for c in ("kept_id", "kept_hash", "kept_once", "kept_once_hash"))
    plain = docs.select(own.alias("own"), th.alias("th"), text.alias("text"))
    signed = saved(plain.mapInArrow(_signed(shingle), "own long, th long, node long, bands array<long>"), "signed")
    groups = saved(signed.groupBy("node").agg(F.min(F.struct("own", "th", "bands")).alias("first")).select("node", "first.*"), "groups")
    classes = near_duplicates(plain.select(F.col("own").alias("doc_id"), "text"), radius=2, shingle=shingle).select(F.col("doc_id").alias("own"), F.xxhash64(F.lit("class"), "component_id").alias("key")).distinct()
    texts = groups.where(F.size("bands") > 0)
    keys = texts.select("node", F.explode("bands").alias("key")).unionByName(texts.select("node", "own").join(classes.hint("merge"), "own").select("node", "key"))
    keys = saved(keys, "keys")
    buckets = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least <> most").drop("most")
    members = saved(keys.join(buckets.hint("merge"), "key"), "members")
    keep = groups.select(F.struct("own", "th").alias("first"), F.col("node").alias("label"))
    if not members.isEmpty():
        wanted = members.select("node").distinct().join(groups.hint("merge"), "node").select("node", F.col("own").alias("w_own"), F.col("th").alias("w_th"))
        found = plain.join(wanted.hint("merge"), (F.col("own") == F.col("w_own")) & (F.col("th") == F.col("w_th"))).select("node", "text").dropDuplicates(["node"])
        sets = saved(found.mapInArrow(_sets(shingle), "node long, hashes array<long>"), "sets")
        labels = saved(components(_star_links(members, sets, part, whole)).select("node", F.col("root").alias("label")), "labels")
        named = saved(members.where("n > 2").join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "named")
        unsettled = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
        open_ = saved(named.join(unsettled.hint("merge"), "key"), "unsettled")
        if not open_.isEmpty():
            last = saved(components(_open_links(open_, sets, part, whole, block_rows, block_hashes)).select(F.col("node").alias("l"), "root"), "last")
            every = groups.select("node").join(labels.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("l"))
            labels = saved(every.join(last.hint("merge"), "l", "left").select("node", F.coalesce("root", "l").alias("label")), "labels")
        keep = groups.select("node", F.struct("own", "th").alias("first")).join(labels.hint("merge"), "node", "left").select("first", F.coalesce("label", "node").alias("label"))
    keep = keep.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.own").alias(kept_id), F.col("first.th").alias(kept_th))
    keep = saved(keep, "kept")
    rows = docs.join(keep.hint("merge"), (own == F.col(kept_id)) & (th == F.col(kept_th)), "left_semi")
    repeated = signed.groupBy("own", "th").count().where("count > 1")
    if repeated.isEmpty():
        return rows
    return rows.withColumns({once: own, once_th: th}).dropDuplicates([once, once_th]).drop(once, once_th)
