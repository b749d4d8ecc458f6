"""SimHash fingerprints, their links within a small Hamming radius, and groups of documents.

Fingerprints within ``radius`` bits agree on at least BLOCKS - radius of the BLOCKS blocks of
their bits. Every choice of so many blocks is a key, and fingerprints that share a key are
compared bit-sliced: plane b holds bit b of 64 fingerprints in one word, the differing bits
of one fingerprint to all 64 are counted at once by carry-save adders, and a word is left as
soon as all its 64 fingerprints are beyond the radius. Sharing a key leaves 16 free bits, so
no group can hold more than 65,536 fingerprints, whatever the data. Pairs are not written out:
each group gives one edge a fingerprint that has a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import lookup, per_batch
from .components import components

SEED = 42
BLOCKS, BLOCK_BITS = 8, 8
#: Shingles hashed at once, and words of 64 compared at once; both bound the memory of a task.
CHUNK, PAIRS = 1 << 16, 1 << 18


def simhash(text: str, size: int) -> int:
    """The bits set in more than half of the hashes of the ``size``-word shingles, as unsigned."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    stops = ends[size - 1 :] if len(words) > size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(stops), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * ones > len(stops), bitorder="little")
    return int(set_.view("<u8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """A signed 64-bit fingerprint. Null texts and texts without words get 0."""

    def work(texts: list) -> pa.Array:
        found = np.array([simhash(t or "", size) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return per_batch(work, "bigint")(text)


def near(fingerprints: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``i < j`` of one group within ``radius`` bits, as two arrays of indices.

    ``fingerprints`` hold the free bits (uint16), sorted by ``groups``.
    """
    n = len(fingerprints)
    begins = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    counts = np.diff(np.r_[begins, n])
    place = np.arange(n) - np.repeat(begins, counts)
    # words of 64 fingerprints, none of them across two groups
    first_of_word = np.flatnonzero(place % 64 == 0)
    word_of = np.cumsum(place % 64 == 0) - 1
    bit = (place % 64).astype(np.uint64)
    planes = [
        np.bitwise_or.reduceat(((fingerprints >> b) & 1).astype(np.uint64) << bit, first_of_word)
        for b in range(16)
    ]
    filled = np.bitwise_or.reduceat(np.uint64(1) << bit, first_of_word)
    last_word = np.repeat(word_of[begins + counts - 1], counts)
    to_do = last_word - word_of + 1  # each fingerprint meets its own word and later ones
    left, right = [], []
    upto = np.cumsum(to_do)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS)))
        rows = np.repeat(np.arange(at, stop), to_do[at:stop])
        offset = np.arange(len(rows)) - np.repeat(upto[at:stop] - to_do[at:stop] - (upto[at - 1] if at else 0), to_do[at:stop])
        words = word_of[rows] + offset
        own = fingerprints[rows]
        counters = [np.zeros(len(rows), np.uint64) for _ in range(radius.bit_length())]
        beyond = np.zeros(len(rows), np.uint64)
        for b in range(16):
            carry = planes[b][words] ^ -((own >> b) & 1).astype(np.uint64)
            for i, counter in enumerate(counters):
                counters[i], carry = counter ^ carry, counter & carry
            beyond |= carry
            if b % 4 == 3:  # above the radius but not yet carried over
                over = beyond | _above(counters, radius)
                live = (~over & filled[words]) != 0
                if not live.all():
                    rows, words, own, beyond = rows[live], words[live], own[live], beyond[live]
                    counters = [c[live] for c in counters]
        close = ~(beyond | _above(counters, radius)) & filled[words]
        for i in np.flatnonzero(close):
            mask, base = int(close[i]), int(first_of_word[words[i]])
            while mask:
                low = mask & -mask
                j = base + low.bit_length() - 1
                if j > rows[i]:
                    left.append(int(rows[i]))
                    right.append(j)
                mask ^= low
        at = stop
    return np.array(left, np.int64), np.array(right, np.int64)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the bit-sliced counts are more than ``radius``."""
    above = np.zeros_like(counters[0])
    same = ~above
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            above |= same & counters[i]
            same &= ~counters[i]
    return above


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that links lead to, for each of ``n``."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Groups (table, fingerprints, ids) to edges between ids, one for each linked fingerprint."""
    free = list(combinations(range(BLOCKS), radius))
    for batch in batches:
        members = batch.column("members")
        offsets = members.offsets.to_numpy()
        counts = np.diff(offsets)
        flat = members.flatten()
        bits = flat.field("fingerprint").to_numpy().view(np.uint64)
        ids = flat.field("id").to_numpy()
        groups = np.repeat(np.arange(len(counts)), counts)
        tables = np.repeat(batch.column("way").to_numpy(), counts)
        rest = np.zeros(len(bits), np.uint16)
        for way, blocks in enumerate(free):
            of = tables == way
            for i, block in enumerate(blocks):
                part = (bits[of] >> np.uint64(BLOCK_BITS * block)) & np.uint64(255)
                rest[of] |= (part << np.uint64(BLOCK_BITS * i)).astype(np.uint16)
        left, right = near(rest, groups, radius) if len(bits) else (groups, groups)
        root = _roots(len(bits), left, right)
        linked = np.flatnonzero(root != np.arange(len(bits)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"]
        )


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` that join the ids of all fingerprints within ``radius`` of each other.

    ``distinct`` has ``fingerprint`` and ``id``, one row a fingerprint. The edges of a group
    span what is linked in it; they are as many as its linked fingerprints at most.
    """
    if not 1 <= radius <= 2:
        raise ValueError("the radius is 1 or 2: two blocks of 8 bits are free")
    keys = []
    for way, blocks in enumerate(combinations(range(BLOCKS), radius)):
        gone = sum(255 << (BLOCK_BITS * b) for b in blocks)
        mask = ~gone & (1 << 64) - 1
        kept = F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        keys.append(F.struct(F.lit(way).alias("way"), kept.alias("key")))
    # Narrow rows become one a key: dealt out first, since a small table comes in few pieces.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartition(tasks, "fingerprint")
    ways = dealt.select("fingerprint", "id", F.inline(F.array(*keys)))
    groups = (
        ways.groupBy("way", "key")
        .agg(F.collect_list(F.struct("fingerprint", "id")).alias("members"))
        .where(F.size("members") > 1)
        .select("way", "members")
    )
    found = groups.mapInArrow(lambda it: _edges(it, radius), "a bigint, b bigint")
    return found.distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 3,
    radius: int = 2,
) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` (signed), ``component_id``: the smallest linked doc_id.

    ``group`` is one of the fingerprints of the component, also where it has no id.

    Documents link where their fingerprints differ in at most ``radius`` bits. Copies meet
    in one row a fingerprint first, so links join texts that differ. Texts without words
    (null, empty) share fingerprint 0. Repeated rows stay; rows with a null id keep it and
    have their group's smallest id, null if it has none. An empty table gives no rows.
    """
    marked = durable(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            text_hash(text).alias("text_hash"),
            fingerprint(F.col(text), size).alias("fingerprint"),
        )
    )
    distinct = durable(
        marked.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    )
    # A node is a fingerprint, so those of null ids link too; an id that stands at several
    # fingerprints joins them all.
    nodes = distinct.select("fingerprint", F.col("fingerprint").alias("id"))
    prints = marked.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("fingerprint").alias("b"), F.max("fingerprint").alias("most"), F.count(F.lit(1)).alias("n")
    )
    repeated = durable(prints.where(F.col("b") != F.col("most")).select("doc_id", "b", "n"))
    same = (
        lookup(marked.select("doc_id", "fingerprint"), repeated, ["doc_id"], "n", marked.count(), "inner")
        .select(F.col("fingerprint").alias("a"), "b")
        .distinct()
    )
    found = components(links(nodes, radius).union(same))
    grouped = durable(
        distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "rows", "id", F.coalesce("component", "fingerprint").alias("group")
        )
    )
    least = durable(grouped.groupBy("group").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    labels = lookup(grouped, least, ["group"], "prints", grouped.count(), "inner").drop("id")
    return lookup(marked, durable(labels), ["fingerprint"], "rows", marked.count()).select(
        "doc_id", "text_hash", "fingerprint", "component_id", "group"
    )


def text_hash(text: str) -> Column:
    """A hash of a text, to tell rows with the same id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hexadecimal(fingerprint: Column) -> Column:
    """The 16 lower-case hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
