"""A word-level BPE tokenizer that encodes each distinct pre-token of a batch once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The id that ends each document.
END_ID = 1
_made: dict[tuple[str, int], WordIds] = {}

#: Classes of bytes: white space, letters, digits, marks, and those whose whole word goes to the library.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
_CLASS = np.full(256, ODD, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[33:127] = SIGN
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER  # C3 begins the Latin letters from U+00C0 on
_CLASS[48:58] = DIGIT
_CLASS[ord("'")] = ODD  # contractions
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    rest = np.flatnonzero((data >= 0x80) & (data < 0xC0))  # continuation bytes; U+00D7 and U+00F7 are no letters
    latin = (data[rest - 1] == 0xC3) & (data[rest] != 0x97) & (data[rest] != 0xB7)
    kind[rest[latin]] = LETTER
    kind[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = ODD
    return kind


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The encoding units of all texts in a row, as binaries, and the number of units up to each text's end.

    In a word (a run without ASCII white space) of ASCII signs, digits, ASCII letters and Latin letters U+00C0 to
    U+00FF, each run of letters, each digit and each run of signs is a pre-token of its own, and lower-casing is all that normalising does.
    A word with any other character, an apostrophe or the beginning of a special token (``<|``) is one unit, unchanged.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(texts), dtype=np.int64)
    kind = _kinds(data)
    solid = kind != SPACE
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = solid[begins]
    starts = kind == DIGIT
    starts[1:] |= kind[1:] != kind[:-1]
    starts &= solid
    starts |= first
    low = _LOWER[data]
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        words = np.flatnonzero(first)
        hit = np.unique(np.searchsorted(words, odd, side="right") - 1)
        stop = np.append(words, len(data))[hit + 1]
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[words[hit]] += 1
        inside[stop] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        starts &= first | ~inside
        np.copyto(low, data, where=inside)
    offsets = np.append(np.flatnonzero(starts[solid]), np.count_nonzero(solid)).astype(np.int64)
    counts = np.searchsorted(np.flatnonzero(starts), ends[1:], side="left")
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])]), counts


def _bytes(values: pa.Array) -> list[bytes]:
    """The values of a fresh large binary array; much faster than ``to_pylist``."""
    if not len(values):
        return []
    _, cuts, data = values.buffers()
    cuts, raw = np.frombuffer(cuts, dtype=np.int64)[: len(values) + 1].tolist(), data.to_pybytes()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class WordIds:
    """Ids of texts as the ``tokenizers`` library gives them, with ``add_special_tokens`` false.

    In this vocabulary's pipeline nothing crosses ASCII white space: it normalises (NFC, lower case) character by
    character, drops white space, and merges within a pre-token only; strings of special tokens, which the library looks for
    in the raw text, hold no white space. So a text's ids are its units' ids in a row (see :func:`units`), and each distinct unit of a
    batch is encoded once. Known units of up to 32 bytes stay in two generations of at most ``limit`` entries and a batch's: when the
    young one is full it becomes the old one, so memory is bounded and units still in use survive. Plain units go
    straight to the library's BPE model, all others its whole way.
    """

    def __init__(self, path: str, limit: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # the same model in memory, without normaliser or special tokens
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.limit = limit
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.end = END_ID.to_bytes(4, "little")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        byte_chars = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_pairs = {c: c.encode().decode("latin-1").translate(byte_chars) for c in map(chr, range(0xC0, 0x100))}

    def _learn(self, found: list[bytes]) -> list[bytes]:
        """Ids of new units: plain ones through the model alone, the rest the library's whole way."""
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        kinds = _kinds(np.frombuffer(b"".join(found), dtype=np.uint8))
        starts = np.cumsum(lengths) - lengths
        low, high = np.minimum.reduceat(kinds, starts), np.maximum.reduceat(kinds, starts)
        plain = (low == high) & ((low == LETTER) | (low == SIGN) | (low == DIGIT) & (lengths == 1))
        out: list[bytes] = [b""] * len(found)
        at = np.flatnonzero(plain).tolist()
        for i in range(0, len(at), 1024):
            part = at[i : i + 1024]
            shown = b" ".join([found[k] for k in part]).decode().lower()  # Latin letters: no other form by context
            if not shown.isascii():
                for letter in set(shown):
                    if letter > "\x7f":
                        shown = shown.replace(letter, self.byte_pairs[letter])
            ids = np.array(self.words.encode(shown, add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()  # a unit's last id alone carries the end mark
            raw, before = ids.tobytes(), 0
            for k, to in zip(part, ends, strict=True):
                out[k] = raw[before:to]
                before = to
        at = np.flatnonzero(~plain).tolist()
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            for k, got in zip(part, self.tokenizer.encode_batch_fast([found[k].decode() for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(got.ids, dtype="<u4").tobytes()
        return out

    def _known(self, found: list[bytes]) -> list[bytes]:
        """The ids of distinct units; short ones are remembered."""
        young, old, missing = self.young, self.old, []
        out = list(map(young.get, found))
        for k in [k for k, x in enumerate(out) if x is None]:
            u = found[k]
            x = out[k] = old.get(u)
            if x is None:
                missing.append(k)
            else:
                young[u] = x
        if missing:
            for k, x in zip(missing, self._learn([found[k] for k in missing]), strict=True):
                u = found[k]
                out[k] = x
                if len(u) <= 32:
                    young[u] = x
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out

    def ids(self, texts: pa.Array, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin, with the end of the last; a null is an empty text.
        With ``end`` each text's ids are followed by :data:`END_ID`."""
        found, counts = units(texts)
        coded = found.dictionary_encode()
        values = self._known(_bytes(coded.dictionary))
        at = coded.indices.to_numpy()
        if end:
            at = np.insert(at, counts, len(values))
            values.append(self.end)
            counts = counts + np.arange(1, len(counts) + 1)
        taken = pa.array(values, pa.large_binary()).take(pa.array(at))
        if not len(taken):
            return np.zeros(0, dtype="<u4"), np.zeros(len(counts) + 1, dtype=np.int64)
        starts = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1] // 4
        return np.frombuffer(taken.buffers()[2] or b"", dtype="<u4")[: starts[-1]], starts[np.concatenate([[0], counts])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, starts = self.ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def word_ids(path: str, limit: int = 150_000) -> WordIds:
    """The worker's own encoder for this vocabulary."""
    if (path, limit) not in _made:
        _made[path, limit] = WordIds(path, limit)
    return _made[path, limit]
