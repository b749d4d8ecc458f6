"""Contiguous shards of nearly equal bytes, cut at equal targets of a global prefix sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: What a document takes besides its text.
FRAME = 8
#: A group of copies of at most this share of a shard is not cut, if the caller does not say else.
SLACK = 0.01
_ORDER = ["copies", "doc_id", "size", "text_crc32"]


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row a document: its id, size in bytes, CRC-32, and a hash that copies share.

    A null text takes no bytes and has the CRC-32 of an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + FRAME).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.xxhash64(whole).alias("copies"),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the bytes and rows that stand before each row in it."""
    part = TaskContext.get().partitionId()
    size_before = rows_before = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        upto = np.cumsum(size) + size_before
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            batch.columns
            + [pa.array(np.full(n, part)), pa.array(upto - size), pa.array(np.arange(n) + rows_before)],
            batch.schema.names + ["part", "before", "row"],
        )
        if n:
            size_before, rows_before = int(upto[-1]), rows_before + n


def positions(sized: DataFrame) -> tuple[DataFrame, int]:
    """Every row of ``sizes`` with its byte and row position in the global order, and all bytes.

    The rows are sorted over the cluster. Only the totals of each partition go to the driver.
    """
    ordered = durable(sized).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    schema = ordered.schema.simpleString()[7:-1] + ",part:bigint,before:bigint,row:bigint"
    stored = durable(ordered.mapInArrow(_running, schema))
    totals = stored.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).orderBy("part").collect()
    offsets, size, rows = [], 0, 0
    for part, part_size, part_rows in totals:
        offsets.append((part, size, rows))
        size, rows = size + part_size, rows + part_rows
    base = sized.sparkSession.createDataFrame(offsets, "part bigint, base bigint, base_row bigint")
    placed = stored.join(F.broadcast(base), "part").select(
        *_ORDER, (F.col("base") + F.col("before")).alias("start"), (F.col("base_row") + F.col("row")).alias("row")
    )
    return placed, size


def _near(cut: int, *borders: int) -> int:
    return min(borders, key=lambda b: (abs(b - cut), b))


def cuts(placed: DataFrame, total: int, shards: int, slack: float = SLACK) -> list[int]:
    """Where each shard after the first begins: the row border nearest to each target.

    A group of copies of at most ``slack`` of a shard is kept whole: its border is taken then.
    """
    targets = [total * k // shards for k in range(1, shards)] if total else []
    if not targets:
        return []
    end = F.col("start") + F.col("size")
    within = lambda c: (F.col("start") <= c) & (c < end)
    hit = placed.where(F.exists(F.array(*[F.lit(t) for t in targets]), within))
    rows = hit.select("start", end.alias("end"), "copies").collect()  # one a target at most
    groups = {
        r["copies"]: (r["first"], r["last"])
        for r in placed.where(F.col("copies").isin([r["copies"] for r in rows]))
        .groupBy("copies")
        .agg(F.min("start").alias("first"), F.max(end).alias("last"))
        .collect()
    }
    found = []
    for target in targets:
        row = next(r for r in rows if r["start"] <= target < r["end"])
        first, last = groups[row["copies"]]
        small = (last - first) * shards <= slack * total
        found.append(_near(target, *((first, last) if small else (row["start"], row["end"]))))
    return found


def shard(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", slack: float = SLACK
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Rows stand in the order of a hash of their text, then of doc_id, so that copies are
    neighbours and each source is spread. Shards are contiguous in that order. ``slack``, from
    0 to 1, is the size, in shards, up to which a group of copies is never cut: each border
    of a shard then lies within the larger of half a row and half of ``slack`` of its target, so a
    shard differs from the mean by the larger of one row and ``slack``. A larger group is cut
    like other rows. Slots count from 0 in each shard. Repeated rows are rows of their own; null
    ids come first among copies; a document larger than a shard leaves its neighbours empty;
    an empty table gives no rows.
    """
    if not 0 <= slack <= 1:
        raise ValueError("slack is a share of a shard, from 0 to 1")
    placed, total = positions(sizes(docs, doc_id, text))
    begins = cuts(placed, total, shards, slack)
    passed: Column = F.lit(0)
    if begins:
        passed = F.size(F.filter(F.array(*[F.lit(b) for b in begins]), lambda b: b <= F.col("start")))
    placed = placed.withColumn("shard", passed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, files: int = 4) -> None:
    """Write the documents into one folder a shard, sorted by slot inside each of its files.

    Rows find their place by (doc_id, size, CRC-32); repeated rows take any of their slots.
    """
    keys = ["doc_id", "size", "text_crc32", "nth"]
    whole = F.coalesce(F.col("text"), F.lit(""))
    nth = F.expr("row_number() over (partition by doc_id, size, text_crc32 order by doc_id)")
    named = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id"),
        (F.octet_length(whole) + FRAME).cast("bigint").alias("size"), F.crc32(whole).alias("text_crc32"),
    ).withColumn("nth", nth)
    slots = durable(shard(docs, shards)).withColumn("nth", nth)
    match = [named[k].eqNullSafe(slots[k]) for k in keys]
    placed = named.join(slots, match).select("doc", "shard", "slot")
    parted = placed.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("shard", "_shard", "__shard") if n not in taken)
    slot = next(n for n in ("slot", "_slot", "__slot") if n not in taken)
    parted.select("doc.*", F.col("shard").alias(name), F.col("slot").alias(slot)).write.partitionBy(name).parquet(path)
