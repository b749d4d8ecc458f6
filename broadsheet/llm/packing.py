"""Best-fit decreasing packing of token sequences.

Pieces of one length are alike, and so are open sequences with the same room. So the packing
of all pieces follows from the number of pieces of each length: lengths are taken from the
longest, and a segment tree over the remaining capacities finds the tightest open sequence in
logarithmic time. What comes out are rules (the n-th to m-th piece of a length go to these
sequences), a few for each length, however many documents there are.
"""

from __future__ import annotations

import binascii
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import BySpace

#: Entries of a Python worker's memo of pieces between spaces.
PIECES = 250_000

#: How the ``ByteLevel`` splitting of a tokenizer file cuts a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Rooms:
    """A segment tree over remaining capacities: the smallest one in use that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.leaves)

    def mark(self, room: int, used: bool) -> None:
        at = room + self.leaves
        self.used[at] = used
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room in use of at least ``least``."""
        at = least + self.leaves
        if not self.used[at]:
            # up to the first node with something to its right, then down its left side
            while at > 1 and (at % 2 or not self.used[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules ``(length, first, last, sequence, copies, offset)``.

    Pieces ``first`` up to, not including, ``last`` of the length go ``copies`` to a sequence,
    from ``sequence`` on, side by side from ``offset`` on. The result is that of placing each
    piece by itself, longest first, in the open sequence with the least room that holds it.
    """
    rooms = Rooms(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, how many)
    rules = []
    opened = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            runs.setdefault(room, []).append(run)
            rooms.mark(room, True)

    for length in sorted(counts, reverse=True):
        done, number = 0, counts[length]
        while done < number:
            left = number - done
            room = rooms.tightest(length)
            if room is None:
                room, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = runs[room].pop()
                if not runs[room]:
                    rooms.mark(room, False)
            copies = room // length
            full = min(many, left // copies)
            if full:
                rules.append((length, done, done + full * copies, first, copies, capacity - room))
                done += full * copies
                put(room - copies * length, (first, full))
            rest = min(number - done, copies - 1) if full < many else 0
            if rest:  # the last pieces of this length share one more sequence
                rules.append((length, done, done + rest, first + full, rest, capacity - room))
                done += rest
                put(room - rest * length, (first + full, 1))
            if room < capacity:
                put(room, (first + full + bool(rest), many - full - bool(rest)))
    return rules


def byte_letters() -> dict[str, int]:
    """The character that a byte-level BPE file writes for each byte, and that byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Ids:
    """Texts to ids by a byte-level BPE file, as little-endian unsigned 32-bit numbers.

    The ranks, the splitting and the added tokens come from the file. ``tiktoken`` does the
    merges (the ids are the same, and it takes a third of the time).
    """

    def __init__(self, file: str):
        made = json.loads(file)
        model, split = made["model"], made["pre_tokenizer"]
        fixed = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (
            model["type"] != "BPE"
            or made.get("normalizer")
            or model.get("ignore_merges")
            or any(split.get(k) != v for k, v in fixed.items())
        ):
            raise ValueError("not a plain byte-level BPE file")
        byte_of = byte_letters()
        added = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {
            bytes(map(byte_of.__getitem__, token)): rank
            for token, rank in model["vocab"].items()
            if token not in added
        }
        self.own = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        pack = lambda text: np.array(self.own.encode_ordinary(text), dtype="<u4").tobytes()
        self.plain = BySpace(pack, b"".join, PIECES).encode
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        longest = sorted(map(regex.escape, added), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(longest)})") if added else None

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(self.added.get(p) or self.plain(p) for p in self.special.split(text) if p)


_IDS: dict[str, Ids] = {}

PIECE_SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row a piece, with its number among the pieces of its length in its partition.

    A document is its ids and then ``end_id``. Only one longer than ``capacity`` is cut: its
    first piece may be shorter, all others are full. A null text is an empty one, a document
    of ``end_id`` alone. The tokenizer file is broadcast (1.5 MB, whatever the data).
    """
    with open(path) as file:
        content = file.read()
    key = hashlib.sha256(content.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    schema = PIECE_SCHEMA + (", ids array<bigint>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _IDS:
            _IDS[key] = Ids(shared.value)
        encode = _IDS[key].encode
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                size = len(ids) // 4
                begin, stop, number = 0, (size - 1) % capacity + 1, 0
                while begin < size:
                    length = stop - begin
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    own = ids[4 * begin : 4 * stop]
                    row = (doc_id, number, begin, length, binascii.crc32(own), part, nth)
                    rows.append(row + (np.frombuffer(own, "<u4").astype("i8"),) if with_ids else row)
                    begin, stop, number = stop, stop + capacity, number + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
            kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and its ``offset`` there.

    Documents are tokenised once, and the pieces are stored without their ids (unless
    ``with_ids``). The driver sees one count a length and makes one set of rules from them,
    which ``capacity`` bounds. Repeated rows are documents of their own, and which of several
    pieces of one length goes where follows from the stored order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    stored = durable(pieces(named, path, end_id, capacity, with_ids))
    counts = stored.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")))
    totals = dict(offsets.groupBy("length").agg(F.sum("n")).collect())  # a row a length
    # As an Arrow table: a list of rows would go through Python workers of its own on the executors.
    names = ["length", "first", "last", "sequence", "copies", "at"]
    columns = list(zip(*best_fit(totals, capacity))) or [[] for _ in names]
    rules = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))
    placed = stored.join(offsets, ["length", "part"]).withColumn("rank", F.col("skip") + F.col("nth"))
    inside = (F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("last"))
    rule = F.broadcast(rules.withColumnRenamed("length", "of"))
    index = F.col("rank") - F.col("first")
    return placed.join(rule, (F.col("length") == F.col("of")) & inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(index / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + index % F.col("copies") * F.col("length")).cast("bigint").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed sequences themselves, from ``pack(with_ids=True)``."""
    entry = F.struct("offset", "ids", "doc_id")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(entry)).alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
