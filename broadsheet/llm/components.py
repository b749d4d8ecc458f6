"""Connected components by alternating star operations.

Each round joins every node's larger neighbours to the smallest node it knows, and then its
smaller ones, until nothing changes; the rounds grow with the logarithm of the longest path.
Edges never leave the executors. A round's result is written to the shared folder, so a lost
executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: A node's neighbours are joined in so many parts, so that a centre of many fills no task.
PARTS = 8


def _least(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` with ``least``: the smallest of a and all b. Hot a are split in PARTS."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    copies = least.select("a", "least", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")).join(
        copies, ["a", "part"]
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where(F.col("b") < F.col("a"))
    joined = _least(down)
    return (
        joined.where(F.col("b") != F.col("least"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .union(joined.select("a", F.col("least").alias("b")))
        .distinct()
    )


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``a, b``): the smallest node reachable.

    Loops and repeated edges do no harm. Nodes without an edge do not appear.
    """
    now = durable(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _print(now)
    while mark[0]:
        now = durable(_small_star(_large_star(now)))
        before, mark = mark, _print(now)
        if mark == before:
            break
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
