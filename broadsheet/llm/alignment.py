"""How the tokens of two tokenizers lie over each other in the same text.

Both tokenizers cut the same bytes. All documents of a batch are aligned in lockstep: one state of
pointers into the tokens of either side advances for all of them at once. A step links the two
tokens under the pointers, moves past the one that ends first, or past both, which is a cut, and
takes finished documents out of the state. Links are counted over the whole corpus. For that the
documents of a block share a dictionary of linked id pairs, the dictionaries (not the links) are
shuffled and added up, and the sums come back to the blocks.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import durable
from .packing import Ids, byte_letters
from .piece_counts import SPACE

#: Bytes of text aligned in one batch, and of a block, whose documents share a dictionary.
BATCH_BYTES, BLOCK_BYTES = 2 << 20, 48 << 20
#: A longer document is dealt to several lanes of about so many tokens, between places where both sides end.
LANE, AHEAD = 2048, 32

class Side(NamedTuple):
    """Tokens of a batch of documents, one after the other."""

    ids: np.ndarray
    ends: np.ndarray  # of each token in the bytes of its document
    starts: np.ndarray  # the first token of each document, and the number of all tokens


class Tokenizers:
    """Side A, a byte-level BPE file, and side B, a sentencepiece model with byte fallback.

    Both encode a space and the text, without special tokens; B adds the space itself.
    """

    def __init__(self, file: str, model: bytes):
        made = json.loads(file)
        byte_of = byte_letters()
        added = {t["content"] for t in made["added_tokens"]}
        bytes_a = [b""] * (1 + max(made["model"]["vocab"].values()))
        for token, rank in made["model"]["vocab"].items():
            bytes_a[rank] = token.encode() if token in added else bytes(map(byte_of.__getitem__, token))
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        bytes_b = [
            bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(map(processor.id_to_piece, range(processor.get_piece_size())))
        ]
        self.a, self.b = Ids(file).own.encode_ordinary, processor.encode
        self.tables = bytes_a, bytes_b
        self.sizes = [np.array(list(map(len, table)), np.int64) for table in self.tables]
        self.labels = [
            b"%d%s" % (i, end)
            for table, ends in ((bytes_a, (b",", b"|")), (bytes_b, (b",", b";")))
            for i in range(len(table))
            for end in ends
        ]

    def sides(self, texts: list) -> tuple[Side, Side]:
        """Both sides of the texts; without tokens where null, empty or with other bytes on a side."""
        found: tuple[list, list] = ([], [])
        for text in texts:
            own = " " + text if text else ""
            ids = (self.a(own), self.b(text)) if text else ([], [])
            raw = own.encode()
            if any(b"".join(map(table.__getitem__, i)) != raw for table, i in zip(self.tables, ids)):
                ids = [], []
            for side, i in zip(found, ids):
                side.append(array("I", i))
        return _side(found[0], self.sizes[0]), _side(found[1], self.sizes[1])


def _side(rows: list[array], sizes: np.ndarray) -> Side:
    starts = np.concatenate([[0], np.cumsum(list(map(len, rows)))]).astype(np.int64)
    ids = np.frombuffer(b"".join(rows), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes[ids])
    before = np.concatenate([[0], ends])[starts[:-1]]
    return Side(ids, ends - np.repeat(before, np.diff(starts)), starts)


def lanes(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes start on both sides: every document, and long ones again where both sides end."""
    from_a, from_b = [a.starts], [b.starts]
    for doc in np.flatnonzero(np.diff(a.starts) > 2 * LANE):
        ends_a, ends_b = (s.ends[s.starts[doc] : s.starts[doc + 1]] for s in (a, b))
        near = np.arange(LANE, len(ends_a) - AHEAD, LANE)[:, None] + np.arange(AHEAD)
        at = np.searchsorted(ends_b, ends_a[near])
        both = ends_b[at] == ends_a[near]
        some = both.any(axis=1)
        pick = both.argmax(axis=1)[some]
        from_a.append(a.starts[doc] + near[some, pick] + 1)
        from_b.append(b.starts[doc] + at[some, pick] + 1)
    return np.unique(np.concatenate(from_a)), np.unique(np.concatenate(from_b))


def lockstep(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links as places in the tokens of both sides, in text order, and whether a link is a cut."""
    from_a, from_b = lanes(a, b)
    rooms = np.diff(from_a) + np.diff(from_b)  # more links than that no lane has
    state = np.stack([from_a[:-1], from_b[:-1], np.cumsum(rooms) - rooms])  # pointers, and the next link
    stop = from_a[1:]
    links_a, links_b = (np.empty(int(rooms.sum()), np.int32) for _ in range(2))
    kind = np.zeros(len(links_a), np.int8)  # 0: no link, 1: link, 2: cut
    while state.shape[1]:
        at_a, at_b, out = state
        end_a, end_b = a.ends[at_a], b.ends[at_b]
        past_a, past_b = end_a <= end_b, end_b <= end_a
        links_a[out], links_b[out] = at_a, at_b
        kind[out] = 1 + (past_a & past_b)
        at_a += past_a
        at_b += past_b
        out += 1
        live = at_a < stop
        if not live.all():
            state, stop = state[:, live], stop[live]
    made = kind > 0
    return links_a[made], links_b[made], kind[made] == 2


def digests(tokenizers: Tokenizers, a: Side, b: Side, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
    """The hash of each document's groups; ``last_a`` and ``last_b`` are the last tokens of all groups."""
    if not len(last_a):
        return [""] * (len(a.starts) - 1)
    group_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
    group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    before_b = np.concatenate([[0], last_b + 1])
    place_a = np.arange(len(a.ids)) + before_b[group_a]
    place_b = np.arange(len(b.ids)) + last_a[group_b] + 1
    order[place_a], order[place_b] = 2 * a.ids, 2 * (len(tokenizers.tables[0]) + b.ids)
    order[place_a[last_a]] += 1
    order[place_b[last_b]] += 1
    label = tokenizers.labels.__getitem__
    out = []
    starts = (a.starts + b.starts).tolist()
    for begin, end in zip(starts, starts[1:]):
        groups = b"".join(map(label, order[begin:end].tolist()))[:-1]
        out.append(hashlib.sha256(groups).hexdigest() if end > begin else "")
    return out


_TOKENIZERS: dict[str, Tokenizers] = {}

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_LISTS = ["links_a", "links_b", "cuts"]
_STORED = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, places array<int>, times array<int>, "
    "place int, a int, b int, links bigint"
)


class Block:
    """The dictionary of linked id pairs of some documents: a place for each pair, and its links."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.place: dict[int, int] = {}
        self.links = np.zeros(0, np.int64)

    def places(self, pairs: np.ndarray) -> np.ndarray:
        codes, found = pd.factorize(pairs)
        own = np.array([self.place.setdefault(p, len(self.place)) for p in found.tolist()], np.int64)
        grown = np.zeros(len(self.place), np.int64)
        grown[: len(self.links)] = self.links
        grown[own] += np.bincount(codes, minlength=len(found))
        self.links = grown
        return own[codes]


def _documents(tokenizers: Tokenizers, block: Block, ids: list, texts: list, lists: bool) -> pa.RecordBatch:
    a, b = tokenizers.sides(texts)
    at_a, at_b, cut = lockstep(a, b)
    places = block.places(a.ids[at_a] * len(tokenizers.tables[1]) + b.ids[at_b])
    doc = np.repeat(np.arange(len(texts)), np.diff(a.starts))[at_a]
    distinct, times = np.unique(doc << 32 | places, return_counts=True)
    n_links, n_groups = (np.bincount(d, minlength=len(texts)) for d in (doc, doc[cut]))
    split = lambda values, sizes, kind: pa.ListArray.from_arrays(
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, kind)
    )
    per_doc = np.bincount(distinct >> 32, minlength=len(texts))
    none = lambda kind: pa.nulls(len(texts), kind)
    columns = {
        "block": pa.array([block.number] * len(texts), pa.int64()),
        "doc_id": pa.array(ids, pa.int64()),
        "n_a": pa.array(np.diff(a.starts)),
        "n_b": pa.array(np.diff(b.starts)),
        "n_groups": pa.array(n_groups, pa.int64()),
        "n_links": pa.array(n_links, pa.int64()),
        "groups_sha256": pa.array(digests(tokenizers, a, b, at_a[cut], at_b[cut]), pa.string()),
        "places": split(distinct & 0xFFFFFFFF, per_doc, pa.int32()),
        "times": split(times, per_doc, pa.int32()),
        "place": none(pa.int32()),
        "a": none(pa.int32()),
        "b": none(pa.int32()),
        "links": none(pa.int64()),
    }
    if lists:
        columns["links_a"] = split(at_a - a.starts[doc], n_links, pa.int32())
        columns["links_b"] = split(at_b - b.starts[doc], n_links, pa.int32())
        columns["cuts"] = split(a.ends[at_a[cut]], n_groups, pa.int64())
    return pa.RecordBatch.from_pydict(columns)


def _dictionary(block: Block, schema: pa.Schema, width: int) -> Iterator[pa.RecordBatch]:
    pairs = np.fromiter(block.place, np.int64, len(block.place))
    for at in range(0, len(pairs), 10_000):
        part = pairs[at : at + 10_000]
        values = {
            "block": pa.array([block.number] * len(part), pa.int64()),
            "place": pa.array(np.arange(at, at + len(part)), pa.int32()),
            "a": pa.array(part // width, pa.int32()),
            "b": pa.array(part % width, pa.int32()),
            "links": pa.array(block.links[at : at + len(part)], pa.int64()),
        }
        yield pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(len(part), f.type)) for f in schema], schema=schema)


def _aligned_blocks(docs: DataFrame, path_a: str, path_b: str, lists: bool) -> DataFrame:
    """Rows of documents (``doc_id`` to ``times``) and of block dictionaries (``place`` to ``links``)."""
    with open(path_a) as file, open(path_b, "rb") as model:
        content = file.read(), model.read()
    key = hashlib.sha256(content[0].encode() + content[1]).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # two MB, whatever the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = Tokenizers(*shared.value)
        tokenizers = _TOKENIZERS[key]
        first = TaskContext.get().partitionId() << 32
        block, schema = Block(first), None
        for ids, texts, size in _batches(batches):
            found = _documents(tokenizers, block, ids, texts, lists)
            schema = found.schema
            yield found
            block.bytes += size
            if block.bytes >= BLOCK_BYTES:
                yield from _dictionary(block, schema, len(tokenizers.tables[1]))
                block = Block(block.number + 1)
        if block.place:
            yield from _dictionary(block, schema, len(tokenizers.tables[1]))

    more = "".join(f", {c} array<{k}>" for c, k in zip(_LISTS, ("int", "int", "bigint"))) if lists else ""
    return docs.mapInArrow(work, _STORED + more)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, int]]:
    """Ids, texts and their size, about BATCH_BYTES at once."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts.append(text.as_py())
            ids.append(i)
            size += len(texts[-1] or "") + 1
            if size >= BATCH_BYTES:
                yield ids, texts, size
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def _sums(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with the corpus-wide counts of their links."""
    place = answers["place"].to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], best[place] = answers["total"].to_numpy(), answers["best"].to_numpy()
    places, times = (documents[c].combine_chunks() for c in ("places", "times"))
    sizes = places.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (places, times))
    for name, value in (("n_best", best), ("count_sum", total)):
        summed = np.zeros(len(sizes), np.int64)
        np.add.at(summed, doc, value[at] * n)
        documents = documents.append_column(name, pa.array(summed))
    return documents.drop_columns(["block", "places", "times"])


def align(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", lists: bool = False
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` for every row.

    ``n_best`` is how many links have the highest count of their B id in the corpus, ties included,
    ``count_sum`` the sum of the counts of all links. With ``lists``, also the links (``links_a``,
    ``links_b``: places in the document's tokens) and ``cuts`` (byte offsets at which groups end,
    the space before the text included). Null and empty texts, and texts that a side does not
    give back byte by byte, have zeros. Whole texts count; a very long one is a batch of its own.
    Repeated rows are documents of their own; only the two columns named are read; an empty
    table gives no rows.
    """
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    stored = durable(_aligned_blocks(named, path_a, path_b, lists))
    entries = stored.where(F.col("place").isNotNull()).select("block", "place", "a", "b", "links")
    counted = durable(entries.withColumn("total", F.sum("links").over(Window.partitionBy("a", "b"))))
    highest = counted.groupBy("b").agg(F.max("total").alias("highest"))  # at most one row a B id
    answers = counted.join(F.broadcast(highest), "b").select(
        "block", "place", "total", (F.col("total") == F.col("highest")).cast("bigint").alias("best")
    )
    kept = ["doc_id", *_COUNTS, "groups_sha256"] + _LISTS * lists
    documents = stored.where(F.col("place").isNull()).select("block", "places", "times", *kept)
    with_links = documents.where(F.col("n_links") > 0).groupBy("block")
    schema = documents.drop("block", "places", "times").schema.add("n_best", LongType()).add("count_sum", LongType())
    found = with_links.cogroup(answers.groupBy("block")).applyInArrow(_sums, schema)
    zero = F.lit(0).cast("bigint")
    without = documents.where(F.col("n_links") == 0).select(*kept, zero.alias("n_best"), zero.alias("count_sum"))
    return found.unionByName(without)
