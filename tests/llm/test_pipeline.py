"""The pipeline's stages one after the other against brute force on a small corpus."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import plain_counts, token_ids
from test_similar import plain_kept

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, fp double, pii_of int"
VILE = ("vileword", "nastyone", "grimcurse")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 clean documents, 120 toxic and 120 poor ones, copies, near copies, private data and odd rows; labels of most."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("bal", "cor", "dim", "fen", "gor") for b in "aeiou" for c in ("do", "ra", "mi", "so", "te")]
    plain = lambda n: [rng.choice(words) + (str(rng.randrange(100)) if rng.random() < 0.3 else "") for _ in range(n)]
    texts, labels = [], []
    for k in range(540):
        body = plain(rng.randrange(30, 150))
        if 300 <= k < 420:
            for _ in range(4):
                body[rng.randrange(len(body))] = rng.choice(VILE)
        if k >= 420:
            body = [w + rng.choice(["***", "$$$", "%%%"]) for w in body]
        if k % 10 == 1 and k < 300:
            body[3:3] = [f"user{k}@mail{k % 3}.example.com", "or", f"+1 (555) 555-{1000 + k}"]
        texts.append(" ".join(body))
        if k % 5:
            labels.append((k, int(k < 420), int(300 <= k < 420)))
    texts += [texts[0], texts[0].upper().lower(), texts[5] + " ", texts[7], texts[7]]
    rows = [(i, t, "en", "src", len(t), "own", 1.5, 3) for i, t in enumerate(texts)]
    rows += [rows[9], (None, texts[11], None, None, None, None, None, None), (None, "some words without an id " + texts[12], None, None, None, None, None, None), (900, None, None, None, None, None, None, None), (901, "", "en", "src", 0, "x", 0.0, 0), (902, texts[13] + " " + " ".join(plain(30_000)), "en", "src", 9, "x", 0.0, 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, corpus):
    """Each stage's rows, written and read again as a job would."""
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus}/out-{name}"
        stage(spark, docs, corpus).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [(df.columns, [r.asDict() for r in df.collect()]) for df in out]


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "private_data", "packing"]
    assert all(columns == stages[0][0] for columns, _ in stages[1:-1]) and stages[-1][0][:4] == ["doc_id", "start", "length", "ids_crc32"]


def as_rows(rows):
    return Counter(tuple(r.values()) for r in rows)


def test_toxic_documents_go(stages):
    assert as_rows(stages[1][1]) == as_rows(r for r in stages[0][1] if not any(w in (r["text"] or "") for w in VILE))


def test_poor_documents_go(stages):
    def good(r):
        n = plain_counts(r["text"])
        return n[0] >= 10 and 100 * n[4] <= 20 * n[0] and n[2] == 0

    assert as_rows(stages[2][1]) == as_rows(r for r in stages[1][1] if good(r))


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2][1]]
    kept = plain_kept(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)))
    assert kept.total() < len(rows) - 5 and Counter((r["doc_id"], r["text"]) for r in stages[3][1]) == kept


def test_private_data_is_hidden_and_nothing_else_changes(stages):
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    before, after = sorted(stages[3][1], key=key), sorted(stages[4][1], key=key)
    assert len(before) == len(after)
    changed = 0
    for a, b in zip(before, after, strict=True):
        assert {k: v for k, v in a.items() if k not in ("text", "n_chars")} == {k: v for k, v in b.items() if k not in ("text", "n_chars")}
        if "@mail" not in a["text"]:
            assert a == b
            continue
        changed += 1
        old, new = a["text"].split(" "), b["text"].split(" ")
        assert len(old) == len(new) and b["n_chars"] == len(b["text"])
        for x, y in zip(old, new, strict=True):
            assert (x != y) == ("@" in x or x[:1] == "(" or "555-" in x)
    assert changed >= 20


def test_packing_holds_every_id(stages, words_path):
    expect = Counter()
    for r in stages[4][1]:
        ids = token_ids(words_path, r["text"])
        expect.update((r["doc_id"], s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in stages[5][1]) == expect


def test_run_is_the_stages(spark, corpus, stages):
    got = corpus_pipeline.run(spark, corpus).select("doc_id", "start", "length", "ids_crc32")
    assert Counter(map(tuple, got.collect())) == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in stages[5][1])


def test_every_stage_takes_an_empty_table(spark, corpus):
    none = spark.read.parquet(f"{corpus}/documents.parquet").where(F.lit(False))
    assert [stage(spark, none, corpus).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
