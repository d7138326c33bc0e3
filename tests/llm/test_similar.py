"""The pipeline's near-copy stage against the Jaccard similarity of all pairs."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from netquarry.llm import similar

SCHEMA = "doc_id long, text string, kept_id string, own int, th int"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(rows):
    """The first (doc_id, text) of each group that pairs of at least 0.8 connect."""
    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return Counter(min((r for r, g in zip(rows, group, strict=True) if g == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(group))


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_word_changed_copies_go(spark):
    rng = random.Random(21)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))] for _ in range(80)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:60]):  # from a single changed word to far below the limit
        rows += [(1000 + 10 * i + k, changed(rng, b, n)) for k, n in enumerate((1, 2, len(b) // 50 + 1, len(b) // 30, len(b) // 6))]
    chain = [f"c{k}" for k in range(200)]
    rows += [(5000 - k, " ".join(chain[6 * k :] + [f"tail{j}" for j in range(6 * k)])) for k in range(8)]  # neighbours alike, ends not
    rows += [(6000, None), (6001, ""), (6002, " \t"), (6003, "three short words"), (6004, "Three  short WORDS"), (7, "another text with the id of a clean document in it"), (None, "a text without any id at all here")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in [*rows, rows[3]]], SCHEMA)
    got = corpus_pipeline.drop_copies(spark, df, "")
    assert got.columns == df.columns
    expect = plain_kept(rows)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == expect and len(expect) < len(rows) - 100
    assert corpus_pipeline.drop_copies(spark, df.where(F.lit(False)), "").count() == 0


def test_large_groups_are_compared_in_blocks(spark):
    """Groups of many blocks: one family around a text, and a chain of families that only some members connect."""
    rng = random.Random(22)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, changed(rng, base, 1 + i % 3)) for i in range(60)]
    rows += [(100 + i, changed(rng, base, 3 + i % 3)) for i in range(40)]  # pairs among these are mostly below the limit
    rows += [(200 + i, " ".join([f"d{k}" for k in range(5 * (i % 10), 100 + 5 * (i % 10))] + [f"e{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expect = plain_kept(rows)
    assert 10 < len(expect) < 100
    for size in (8, 2048):
        got = similar.keep_first(df, block_rows=size)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == expect, size


def test_links_are_exact_within_a_block():
    rng = np.random.default_rng(1)
    base = [rng.choice(4000, n, replace=False) for n in (50, 51, 400, 3)]
    sets = [np.unique(np.where(rng.random(len(b)) < share, rng.integers(5000, 9000, len(b)), b)).astype(np.uint64) for b in base for share in (0, 0.02, 0.08, 0.1, 0.12, 0.15, 0.5)]
    for labels in (np.arange(len(sets)), np.arange(len(sets)) // 3):
        group = labels.tolist()
        join = lambda x, y: [y if g == x else g for g in group]  # noqa: E731, B023
        for i in range(len(sets)):
            for j in range(i):
                if alike(set(sets[i].tolist()), set(sets[j].tolist())):
                    group = join(group[i], group[j])
        expect, group = group, labels.tolist()
        for a, b in zip(*similar.linked_labels(sets, labels, 4, 5), strict=True):
            group = join(a, b)
        assert len(set(group)) == len(set(expect))
        assert all((group[i] == group[j]) == (expect[i] == expect[j]) for i in range(len(sets)) for j in range(len(sets)))
