import random

import public_tokenizers
import pytest

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="session")
def words_path():
    return WORDS


@pytest.fixture(scope="session")
def ranks_path():
    return BYTES


def prose(rng: random.Random, n: int, base: str = "") -> str:
    parts = ["ba", "ce", "di", "fo", "gu", "lo", "ma", "ne", "pi", "ro", "su", "ta"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return base + " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """Nulls, empties, blanks, repeats, near copies, odd characters and one very long text."""
    rng = random.Random(5)
    some = [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    near = [some[0] + " tail", some[0].replace("ba", "BA"), some[1]]
    odd = [None, "", " \t\n", "x", "ΣΑΣ İ ﬁ １２ \u0001 a\x1cb \x85 c\xa0d", "~ a~ ~~", "<|endoftext|> it's I'LL", "日本語 " * 30, "H̱ é", "aaaa" * 900, "\t" * 70]
    return some + near + odd + [prose(rng, 30_000)]


@pytest.fixture
def docs(spark, texts):
    """The texts as documents with clashing extra columns; one row twice, one without an id."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 7) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, length int")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
