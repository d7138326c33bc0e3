"""Byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, column

NEVER = 1 << 62
_made: dict[tuple[str, str], Codec] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Ranks, and what decides whether two tokens may stand side by side in an encoding.

    A token grows from single bytes by merges. While BPE works on the bytes of ``a + b``, the part of ``a`` that
    touches the border is first its last byte, then the right halves that merge into one another, and finally
    ``a`` itself; likewise for ``b`` on its side. The pair stands if at no time a merge across the border would
    have come before the next merge on either side. ``tails`` and ``heads`` list these parts with the rank of
    the merge that ends each.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 400_000):
        self.ranks, self.limit = ranks, limit
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.tails: dict[int, list[tuple[bytes, int]]] = {}
        self.heads: dict[int, list[tuple[bytes, int]]] = {}
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                sizes.setdefault(token[-3:], {1, 2}).add(len(token))
        #: Lengths of tokens by their last three bytes, longest first.
        self.sizes = {tail: tuple(sorted(n, reverse=True)) for tail, n in sizes.items()}
        self.longest = max(map(len, ranks))
        self.fits_memo: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token``; None for a byte or a token that merges never make."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        whole = ranks[token]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NEVER))
            if ranks.get(parts[best] + parts[best + 1], NEVER) >= whole:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def spine(self, rank: int, side: int) -> list[tuple[bytes, int]] | None:
        """The parts on one side of a token, smallest first, each with the rank of the merge that ends it."""
        known = self.tails if side else self.heads
        if rank not in known:
            token = self.tokens[rank]
            both = self.halves(token)
            if both is None:
                known[rank] = [(token, NEVER)] if len(token) == 1 else []
            else:
                inner = self.spine(self.ranks[both[side]], side)
                known[rank] = [*inner[:-1], (inner[-1][0], rank), (token, NEVER)] if inner else []
        return known[rank]

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``a`` may come right before token ``b``."""
        key = a << 32 | b
        known = self.fits_memo.get(key)
        if known is None:
            left, right, i, j, known = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            if not left or not right:
                known = False
            while known:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get(x + y, NEVER)
                if across < x_ends and across <= y_ends:  # of equal ranks the one further left merges first
                    known = False
                elif x_ends == y_ends == NEVER:
                    break
                elif x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.fits_memo) >= self.limit:
                self.fits_memo.clear()
            self.fits_memo[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else Prefixes(self, piece).ids()

    def encode_match(self, match: str) -> bytes:
        return self.young.get(match) or self._piece(match)

    def _piece(self, match: str) -> bytes:
        raw = self.old.get(match)
        if raw is None:
            raw = np.array(self.encode_piece(match.encode()), dtype="<u4").tobytes()
        if len(match) <= 64:
            self.young[match] = raw
        return raw

    def encode(self, text: str | None) -> bytes:
        """A whole text's ids as little-endian unsigned 32-bit integers, each match of the pattern separately.

        Matches repeat, so up to 2 x ``limit`` short ones are remembered, in two generations.
        """
        if not text:
            return b""
        matches, get, piece = self.pattern.findall(text), self.young.get, self._piece
        out = b"".join([get(m) or piece(m) for m in matches])
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Prefixes:
    """The encoding of every prefix of some bytes.

    For each prefix exactly one token can be the last of its encoding: the one token among the prefix's
    suffixes that fits behind the last token of what is before it. Storing that token makes an append exact
    (earlier prefixes don't change) and lets an edit be encoded anew only until the stored tokens agree again.
    """

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def _extend(self, end: int) -> Iterator[int]:
        """Stores and yields the last token of each further prefix, up to ``end`` bytes."""
        codec, data, last = self.codec, self.data, self.last
        rank_of, fits, memo, sizes, short = codec.ranks.get, codec.fits, codec.fits_memo.get, codec.sizes.get, (2, 1)
        for at in range(len(last), end + 1):
            for size in sizes(data[at - 3 : at], short) if at > 2 else short[2 - at :]:
                if size > at or (rank := rank_of(data[at - size : at])) is None:
                    continue
                if size == at:
                    if not codec.spine(rank, 1):
                        continue
                else:
                    before = last[at - size]
                    ok = memo(before << 32 | rank)
                    if not (fits(before, rank) if ok is None else ok):
                        continue
                last.append(rank)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
            yield rank

    def append(self, more: bytes) -> None:
        self.data += more
        for _ in self._extend(len(self.data)):
            pass

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in the place of bytes ``start`` to ``stop``; returns how many prefixes were encoded."""
        old, shift = self.last, len(new) - (stop - start)
        window = self.codec.longest
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same = old[: start + 1], 0
        for at, rank in enumerate(self._extend(len(self.data)), start + 1):
            same = same + 1 if at > start + len(new) and old[at - shift] == rank else 0
            if same > window:  # later tokens depend on no earlier prefix
                done = at - start
                self.last += old[at - shift + 1 :]
                return done
        return len(self.data) - start

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.codec.tokens[self.last[at]])
        return out[::-1]


class Encoded:
    """A text with its encoding, to which text can be appended and in which it can be edited, exactly.

    The pattern's matches follow one another, and where a match begins decides, with the text from there on, all that come after it. What a
    match is can depend on what follows only up to the first character behind it that is not white space. So an edit is matched anew from the
    last match that has such a character between its end and the edit, until a match begins where an old one did behind the edit.
    """

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text, self.starts, self.pieces = codec, "", [], []
        self.append(text)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Puts ``new`` in the place of characters ``start`` to ``stop``; returns how many matches were encoded."""
        text, shift = self.text[:start] + new + self.text[stop:], len(new) - (stop - start)
        first = bisect.bisect_left(self.starts, start)
        while first and (first == len(self.starts) or self.starts[first] >= start or not self.text[self.starts[first] : start].strip()):
            first -= 1
        at, last = self.starts[first] if first < len(self.starts) else 0, bisect.bisect_left(self.starts, stop)
        starts, pieces = [], []
        for match in self.codec.pattern.finditer(text, at):
            begin = match.start()
            while last < len(self.starts) and self.starts[last] + shift < begin:
                last += 1
            if begin >= start + len(new) and last < len(self.starts) and self.starts[last] + shift == begin:
                break
            starts.append(begin)
            pieces.append(self.codec.encode_match(match.group()))
        else:
            last = len(self.starts)
        self.text = text
        self.starts = self.starts[:first] + starts + [x + shift for x in self.starts[last:]]
        self.pieces = self.pieces[:first] + pieces + self.pieces[last:]
        return len(pieces)

    def ids(self) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        return b"".join(self.pieces)


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec for these ranks."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Codec(load_ranks(path), pattern)
    return _made[path, pattern]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    ``docs`` needs doc_id and text; other columns are ignored whatever their names. A null or empty text has no
    ids. Repeated rows and null doc_ids return like others; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in by_bytes(batches):
            ids = [own.encode(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary), the bytes that ``ids`` stand for; null ids are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            data = [own.decode(ids or b"") for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and then decoded from its
    ids in the same task, so that neither is shuffled. Nulls, repeats and empty tables as in :func:`encode`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in by_bytes(batches):
            ids = [own.encode(t) for t in column(batch, "text").to_pylist()]
            arrays = [
                column(batch, "doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
