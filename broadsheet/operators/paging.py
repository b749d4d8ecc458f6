"""Pages of document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ID
from ..session import shared_dir

_WITHIN = (1 << 33) - 1


def position_index(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in order, stored in a folder for each sorted partition.

    ``part`` is the partition and ``at`` the place in it, from 0. The sort is spread over the
    cluster, and no task ever sees all rows.
    """
    ordered = rows.orderBy(*order).select(
        *rows.columns, F.monotonically_increasing_id().bitwiseAND(_WITHIN).alias("at"), F.spark_partition_id().alias("part")
    )
    path = shared_dir(rows.sparkSession)
    ordered.sortWithinPartitions("part", "at").write.partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(ordered.schema).parquet(path)


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with ``n``, their place from 0 in the order.

    The sizes of the partitions before it give each sorted partition its offset.
    """
    placed = position_index(rows, *order)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"))
    return placed.join(F.broadcast(offsets), "part").select(
        *rows.columns, (F.col("skip") + F.col("at")).cast("bigint").alias("n")
    )


def id_pages(articles: DataFrame, chunk_size: int = 1000) -> DataFrame:
    """``(identifier, page)``: ids in order, cut into pages of ``chunk_size``."""
    page_of = F.floor(F.col("n") / chunk_size).cast("bigint")
    return numbered(articles.select(ID).distinct(), ID).select(ID, page_of.alias("page"))


def slice_of(index: DataFrame, offset: int, size: int) -> DataFrame:
    """The rows at ``offset`` to ``offset + size`` of a ``position_index``, in order.

    The totals of the partitions (a row each) tell which of them hold the slice; only their
    folders are read, and only the row groups with its places.
    """
    first = last = None
    passed = 0
    for part, count in index.groupBy("part").agg(F.count(F.lit(1))).orderBy("part").collect():
        begin, end = max(offset - passed, 0), min(offset + size - passed, count)
        if begin < end:
            first = first or (part, begin)
            last = (part, end)
        passed += count
    if first is None:
        return index.where(F.lit(False)).drop("part", "at")
    held = (
        F.col("part").between(first[0], last[0])
        & ((F.col("part") > first[0]) | (F.col("at") >= first[1]))
        & ((F.col("part") < last[0]) | (F.col("at") < last[1]))
    )
    return index.where(held).orderBy("part", "at").drop("part", "at")


def page(articles: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of ids by offset and size, however deep; an index serves further pages by ``slice_of``."""
    return slice_of(position_index(articles.select(ID), ID), offset, size)
