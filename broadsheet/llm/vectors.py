"""What both searches share: valid vectors, copies, blocks against blocks, and the best rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def usable(table: DataFrame, vec_id: str, vector: str, nonzero: bool) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part.

    Left out are null ids, vectors that are null or empty or hold a null or non-finite component,
    and zero vectors where ``nonzero``.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = table.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & (F.size("v") > 0))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def by_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """``search`` for the best ``k`` on the vectors of each length; only two of one length have a product.

    ``rows`` is a stored table. A table has one length as a rule; each further one is a search of its
    own. An id that stands at vectors of several lengths gets the best ``k`` of all.
    """
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    if len(lengths) < 2:
        return search(rows)
    found = [search(rows.where(F.size("v") == n)) for n in lengths]
    return ranked(reduce(DataFrame.unionByName, found).drop("rank"), k)


def without_copies(rows: DataFrame, keep: int) -> DataFrame:
    """``vec_id, v, ids``: one row a distinct vector, with its ``keep`` smallest distinct ids in order.

    Copies score alike and rank by id, so no later id can be among the best ``keep``. An id
    stands as often as rows repeat it, at most ``keep - 1`` times: no answer uses more of them.
    Repeats are counted first, so no task holds those of a hot vector.
    """
    repeats = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(keep - 1)).cast("int").alias("n"))
    same = Window.partitionBy("v").orderBy("vec_id")
    first = repeats.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= keep)
    listed = F.sort_array(F.collect_list(F.struct("vec_id", "n")))
    grouped = first.groupBy("v").agg(
        F.flatten(F.transform(listed, lambda x: F.array_repeat(x["vec_id"], x["n"]))).alias("ids")
    )
    return grouped.select(F.col("ids")[0].alias("vec_id"), "v", "ids")


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.array(column.tolist(), dtype) if len(column) else np.zeros((0, 0), dtype)


def best_pairs(
    row: np.ndarray, col: np.ndarray, value: np.ndarray, own: np.ndarray, ids: list[np.ndarray], k: int
) -> pd.DataFrame:
    """The best ``k`` ids for each query among scored pairs of a query and a distinct vector.

    ``row`` counts the queries, whose ids are ``own``; ``col`` the vectors, whose ids are in
    ``ids``. Copies are written out, and no query finds itself.
    """
    counts = np.fromiter((len(ids[c]) for c in col), np.int64, len(col))
    flat = np.concatenate([ids[c] for c in col]) if len(col) else np.zeros(0, np.int64)
    row, value = np.repeat(row, counts), np.repeat(value, counts)
    other = flat != own[row]
    row, flat, value = row[other], flat[other], value[other]
    order = np.lexsort((flat, -value, row))
    row, flat, value = row[order], flat[order], value[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return pd.DataFrame({"query_id": own[row[kept]], "vec_id": flat[kept], "score": value[kept]})


def best_of_matrix(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of what may be among the best ``k`` of each row; ties stay."""
    width = scores.shape[1]
    if width > k + 1:  # the query's own vector may be one of them
        cut = np.partition(scores, width - k - 1, axis=1)[:, width - k - 1]
        row, col = np.nonzero(scores >= cut[:, None])
    else:
        row, col = np.nonzero(np.ones(scores.shape, bool))
    return row, col, scores[row, col]


def best_of_block(scores: np.ndarray, own: np.ndarray, ids: list[np.ndarray], k: int) -> pd.DataFrame:
    """``best_pairs`` of a whole matrix of scores, queries by distinct vectors."""
    return best_pairs(*best_of_matrix(scores, k), own, ids, k)


def together(found: list[pd.DataFrame], columns: dict[str, str]) -> pd.DataFrame:
    full = [f for f in found if len(f)]
    return pd.concat(full) if full else pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})


def meet(
    queries: DataFrame,
    candidates: DataFrame,
    keys: list[str],
    work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """``work`` on the queries and the candidates of each pair of blocks."""
    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(work, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` by score, ties by id. Tasks cut first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def block_of(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """A block number from 0 for each row, by a hash of its id."""
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))


def stored(rows: DataFrame) -> tuple[DataFrame, int]:
    kept = durable(rows)
    return kept, kept.count()
