"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

The ids are those of the merge loop (always the lowest rank first), found in time linear in
the length of a piece. At each place the longest vocabulary entry is tried first, then the
shorter ones that it begins with. An entry may follow its neighbour only where merging both
their bytes gives the same two entries again; the answers to that question are memoised. Where
no entry fits, the last one is taken back and the place is marked as not reachable, so no
place is given up twice. The longest entry of each place comes from one Aho-Corasick pass
over the bytes, written as Latin-1 characters.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession

from .common import BySpace, Memo, per_batch

#: Entries of the memos of one Python worker.
PIECES, WORDS, PAIRS = 250_000, 150_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)
        }


class Encoder:
    """Encodes single pieces (one match of the splitting pattern, as bytes)."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter, PAIRS)
        self.halves = Memo(self._halves, len(ranks) + 1)
        self.fits = Memo(self._fits, PAIRS)

    def _shorter(self, rank: int) -> int | None:
        """The longest other entry that this one begins with."""
        token = self.token[rank]
        for size in range(len(token) - 1, 0, -1):
            if (found := self.ranks.get(token[:size])) is not None:
                return found
        return None

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two entries whose merge makes this one; None for a single byte."""
        token = self.token[rank]
        if len(token) == 1:
            return None
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            lowest, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i)
                for i in range(len(parts) - 1)
            )
            if lowest >= rank:
                raise ValueError(f"entry {rank} is not made by merges of lower rank")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both entries gives these two again.

        Merges are undone from the latest on, at both sides of the border. A pair at the
        border that would have merged before the merge just undone crosses it.
        """
        left, right = pair
        ranks, token = self.ranks.get, self.token
        limit = 1 << 60
        while True:
            if ranks(token[left] + token[right], limit) < limit:
                return False
            of_left, of_right = self.halves[left], self.halves[right]
            if of_left is None and of_right is None:
                return True
            # The border pair merges at the leftmost place first among equal ranks, so an
            # equal rank on the right is undone with one more allowed.
            if of_right is None or (of_left is not None and left > right):
                limit, left = left, of_left[1]
            else:
                limit, right = right + 1, of_right[0]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        chars = piece.decode("latin-1")
        # The longest entries one after the other are often right as they are.
        out = [rank for _, (_, rank) in self.automaton.iter_long(chars)]
        fits = self.fits
        for pair in zip(out, out[1:]):
            if not fits[pair]:
                return self._backtracked(chars)
        return out

    def _backtracked(self, chars: str) -> list[int]:
        size = len(chars)
        longest = [0] * size
        for end, (length, rank) in self.automaton.iter(chars):
            longest[end + 1 - length] = rank  # later ends are longer entries
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        open_ = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, now = 0, longest[0]
        while at < size:
            while now is not None:
                end = at + lengths[now]
                if open_[end] and (not out or fits[out[-1], now]):
                    break
                now = shorter[now]
            if now is None:
                open_[at] = 0
                now = out.pop()
                at -= lengths[now]
            else:
                out.append(now)
                at = end
                now = longest[at] if at < size else None
        return out


class TextCodec:
    """Whole texts to ids, as one string of decimal ids joined by commas, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = Encoder(ranks)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {b"%d" % rank: token for token, rank in ranks.items()}
        self.word = Memo(lambda w: ",".join(map(str, self.encoder.encode(w.encode()))), WORDS)
        self.encode = BySpace(self._cut, ",".join, PIECES).encode

    def _cut(self, text: str) -> str:
        letters = text[1:]
        if text[:1] == " " and letters.isascii() and letters.isalpha():  # one match
            return self.word[text]
        return ",".join(map(self.word.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.encode().split(b","))) if ids else b""


_CODECS: dict[str, TextCodec] = {}


def codec_of(key: str, ranks: dict[bytes, int], pattern: str) -> TextCodec:
    """One codec a worker process and vocabulary."""
    if key not in _CODECS:
        _CODECS[key] = TextCodec(ranks, pattern)
    return _CODECS[key]


def encoded(spark: SparkSession, text: Column, path: str, pattern: str, ids: bool = False) -> Column:
    """A struct column for ``text``: n_tokens, ids_sha256, decoded_sha256, and ids on request.

    The vocabulary is read on the driver and broadcast (about one MB, whatever the data).
    A null text is encoded as an empty one: no ids, and the hashes of nothing. Texts that are
    very long take time and memory in proportion to their length. The result does not depend
    on the other rows, so ties, repeated rows and empty tables need no care.
    """
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((path, pattern, len(ranks))).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def work(texts: list) -> pa.Array:
        codec = codec_of(key, shared.value, pattern)
        rows = []
        for text in texts:
            found = codec.encode(text or "")
            row = (found.count(",") + 1 if found else 0, sha(found.encode()), sha(codec.decode(found)))
            rows.append(row + (([int(i) for i in found.split(",")] if found else []),) if ids else row)
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names
        )

    returns = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string%s>"
    return per_batch(work, returns % (",ids:array<int>" if ids else ""))(text)


def decoded(spark: SparkSession, ids: Column, path: str) -> Column:
    """The bytes of a column of id arrays; null for null. An id not in the vocabulary is an error."""
    shared = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(path).items()})

    def work(rows: list) -> pa.Array:
        token = shared.value.__getitem__
        return pa.array([None if r is None else b"".join(map(token, r)) for r in rows], pa.binary())

    return per_batch(work, "binary")(ids)
