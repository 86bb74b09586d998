"""Byte-level BPE encoding and decoding by monoid tree reduction.

Each match of the pre-tokenisation pattern is encoded on its own. A match that is a token of the vocabulary is that token.
Any other is cut in halves, each half is encoded recursively down to single bytes, and the two token lists are joined: a
window around the seam is decoded to bytes and encoded again, and it grows until both of its edges are
settled. An edge is settled when the two tokens that meet there encode, as a pair, to themselves: a
token list whose neighbours are all compatible in that sense is the encoding of its bytes, since the
first merge across a seam would also happen in the pair alone. Concatenation of encodings is thus a
monoid, and the halves may be reduced in any order. Decoding concatenates byte strings up a balanced tree, from single tokens on.

Defined results: null text encodes as the empty text (no ids, no bytes); repeated rows and extra columns are
kept as they are, but a column with the name of one that is added is replaced; an empty table gives an empty table; a text of any length is
encoded whole. Of two possible merges of equal rank the left one goes first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import extended, map_arrow, with_columns

#: Entries of a worker's memo of encoded matches before it is emptied, and of its memos of seams and short runs.
MEMO = 150_000
SHORT = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary in tiktoken's text form."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Ranks with the encoding and decoding of one match."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: Encodings of two tokens' bytes, and of short runs of bytes; never changed once they are here.
        self.seams: dict[int, list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}
        #: Rank of the token that two tokens make, by their ids packed into one integer.
        self.pairs = {
            ranks[token[:i]] << 24 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }

    def merged(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, over the bytes of a window."""
        pair, none = self.pairs.get, 1 << 24
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        made = [pair(a << 24 | b, none) for a, b in zip(ids, ids[1:])]
        while made and (rank := min(made)) < none:
            i = made.index(rank)
            ids[i : i + 2] = [rank]
            del made[i]
            if i:
                made[i - 1] = pair(ids[i - 1] << 24 | rank, none)
            if i < len(made):
                made[i] = pair(rank << 24 | ids[i + 1], none)
        return ids

    def pair(self, left: int, right: int) -> list[int]:
        """Encoding of what two tokens stand for: themselves, if their seam is settled."""
        key = left << 24 | right
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) >= SHORT:
                self.seams.clear()
            found = self.seams[key] = self.merged(self.bytes_of[left] + self.bytes_of[right])
        return found

    def settled(self, left: int, right: int) -> bool:
        return self.pair(left, right) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of what two encodings stand for."""
        if not left or not right:
            return left + right
        mid, a, b = self.pair(left[-1], right[0]), 1, 1
        if mid == [left[-1], right[0]]:
            return left + right
        while True:
            fixed_left = a == len(left) or self.settled(left[-a - 1], mid[0])
            fixed_right = b == len(right) or self.settled(mid[-1], right[b])
            if fixed_left and fixed_right:
                return left[: len(left) - a] + mid + right[b:]
            a, b = min(a + a * (not fixed_left), len(left)), min(b + b * (not fixed_right), len(right))
            mid = self.merged(b"".join([self.bytes_of[t] for t in chain(left[len(left) - a :], right[:b])]))

    def reduced(self, piece: bytes) -> list[int]:
        """Encoding of a run of bytes by the tree alone."""
        n = len(piece)
        if n == 1:
            return [self.ranks[piece]]
        found = self.parts.get(piece)
        if found is None:
            found = self.joined(self.reduced(piece[: n // 2]), self.reduced(piece[n // 2 :]))
            # Short runs come back in many words.
            if n <= 8:
                if len(self.parts) >= SHORT:
                    self.parts.clear()
                self.parts[piece] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Encoding of one match."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.reduced(piece) if piece else []

    def decode(self, ids: list[int]) -> bytes:
        """Neighbours are concatenated, level by level of the tree."""
        parts = [self.bytes_of[i] for i in ids]
        while len(parts) > 1:
            odd = parts[len(parts) & ~1 :]
            parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + odd
        return parts[0] if parts else b""


class Memo(dict):
    """Encodings of matches seen by a worker; emptied when full, so that memory stays bounded."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = tuple(self.codec.encode(match.encode()))
        if len(match) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[match] = ids
        return ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in an array column, and with ``decoded`` also the bytes they decode to.

    ``ranks`` is the vocabulary (its size is fixed, about 1 MB) and goes to the workers as a broadcast.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(ranks)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        codec = Codec(shipped.value)
        find, memo = regex.compile(pattern).findall, Memo(codec)
        for batch in batches:
            rows = [list(chain.from_iterable(map(memo.__getitem__, find(t)))) if t else [] for t in batch.column(at).to_pylist()]
            offsets = np.zeros(len(rows) + 1, "int32")
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), "int32", int(offsets[-1]))
            more = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
            if decoded:
                more[decoded] = pa.array([codec.decode(r) for r in rows], pa.binary())
            yield with_columns(batch, more)

    return map_arrow(docs, run, extended(docs.schema, f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded else "")))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of the ids in a binary column; null ids give empty bytes."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shipped.value)
        for batch in batches:
            out = pa.array([codec.decode(r or []) for r in batch.column(at).to_pylist()], pa.binary())
            yield with_columns(batch, {decoded: out})

    return map_arrow(encoded, run, extended(encoded.schema, f"`{decoded}` binary"))


def op8(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Counts and digests of an encoding and of its round trip: one row per document."""
    out = encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
