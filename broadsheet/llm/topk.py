"""Exact top-k by inner product, in the three phases of a uniform threshold.

The components of the vectors are dealt into LISTS parts, so a score is the sum of one partial
score a list. Phase one: the best entries of every local list are scored in full; the k-th
best of them is a safe cutoff, for no row beyond the answer reaches it. Phase two: a row whose
score reaches the cutoff has at least one list in which its partial score reaches the cutoff
divided by the number of lists; such entries are collected. Phase three: what their other
lists add is resolved exactly, and rows below the cutoff go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .vectors import best_pairs, block_of, by_length, matrix, meet, ranked, stored, together, usable, without_copies

SCALE = 1024
LISTS = 2
#: Queries and candidates of a block, queries scored at once, and pairs resolved at once.
QUERIES, CANDIDATES, ROWS, PAIRS = 8192, 8192, 256, 1 << 15
_MOST = (1 << 63) - 1


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; beyond 64 bits the nearest 64-bit number."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 52:
        return (a @ b.T).astype(np.int64)
    exact = _exact(a) @ _exact(b).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.vectorize(int, otypes=[object])(values)


def _lists(width: int) -> list[slice]:
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _local_lists(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phase one: the k best full scores among the first entries of this block's lists."""
    out = []
    if len(queries) and len(candidates):
        b = matrix(candidates["v"])
        ids = [np.asarray(i) for i in candidates["ids"]]
        take = min(k + 1, len(b))
        for at in range(0, len(queries), ROWS):
            part = queries.iloc[at : at + ROWS]
            a = matrix(part["v"])
            first = np.zeros((len(a), len(b)), bool)
            for s in _lists(b.shape[1]):
                partial = _products(a[:, s], b[:, s])
                best = np.argpartition(partial, len(b) - take, axis=1)[:, len(b) - take :]
                np.put_along_axis(first, best, True, axis=1)
            row, col = np.nonzero(first)
            out.append(best_pairs(row, col, _pairs(a, b, row, col), part["vec_id"].to_numpy(), ids, k))
    return together(out, dict.fromkeys(("query_id", "vec_id", "score"), "int64"))[["query_id", "score"]]


def _resolved(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phases two and three on one pair of blocks."""
    out = []
    if len(queries) and len(candidates):
        b = matrix(candidates["v"])
        ids = [np.asarray(i) for i in candidates["ids"]]
        lists = _lists(b.shape[1])
        for at in range(0, len(queries), ROWS):
            part = queries.iloc[at : at + ROWS]
            a = matrix(part["v"])
            cutoff = part["cutoff"].to_numpy()
            # Rounded up: partial scores are whole. The least number stands for "no cutoff".
            enough = np.where(cutoff == -_MOST, -_MOST, -(-cutoff // len(lists)))
            reached = np.zeros((len(a), len(b)), bool)
            for s in lists:
                reached |= _products(a[:, s], b[:, s]) >= enough[:, None]
            row, col = np.nonzero(reached)
            score = _pairs(a, b, row, col)
            kept = score >= cutoff[row]
            own = part["vec_id"].to_numpy()
            out.append(best_pairs(row[kept], col[kept], score[kept], own, ids, k))
    return together(out, dict.fromkeys(("query_id", "vec_id", "score"), "int64"))


def _pairs(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact products of pairs of rows, some PAIRS at a time."""
    top = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if top >= 1 << 52:
        a, b = _exact(a), _exact(b)
    out = np.zeros(len(row), np.int64)
    for at in range(0, len(row), PAIRS):
        left, right = a[row[at : at + PAIRS]], b[col[at : at + PAIRS]]
        if top < 1 << 52:
            out[at : at + PAIRS] = np.einsum("ij,ij->i", left, right)
        else:
            out[at : at + PAIRS] = np.clip((left * right).sum(axis=1), -_MOST, _MOST)
    return out


def top_k(
    table: DataFrame,
    k: int = 10,
    every: int = 100,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each id divisible by ``every``.

    Components become floor(scale * x); the score is the integer inner product, which saturates
    at 64 bits. A row is no candidate for its own id. Ties go to the smaller id, and
    copies of a vector are searched once and then written out. Rows that take no part are those
    of ``vectors.usable``; zero vectors do take part. Vectors meet those of their own length. With fewer candidates than ``k`` all are
    returned; an empty table gives no rows. Queries meet candidates in blocks of bounded size.
    """
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    rows = durable(usable(table, vec_id, vector, nonzero=False).select("vec_id", whole.alias("v")))
    return by_length(rows, lambda alike: _top_k(alike, k, every), k)


def _top_k(rows: DataFrame, k: int, every: int) -> DataFrame:
    asked = rows.where(F.col("vec_id") % every == 0)
    q_blocks = max(1, -(-asked.count() // QUERIES))
    distinct, kinds = stored(without_copies(rows, k + 1))
    c_blocks = max(1, -(-kinds // CANDIDATES))
    every_q = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")
    every_c = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb")
    candidates = block_of(distinct, "cb", c_blocks).select("vec_id", "v", "ids", "cb", every_q)
    queries = block_of(asked, "qb", q_blocks)
    keys = ["qb", "cb"]
    local = meet(
        queries.select("vec_id", "v", "qb", every_c), candidates, keys,
        lambda q, c: _local_lists(q, c, k), "query_id bigint, score bigint",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = (
        local.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k)
        .groupBy("query_id")
        # fewer than k entries at all: every row is in the answer
        .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(-_MOST)).alias("cutoff"))
    )
    cutoffs = durable(kth)
    bounded = queries.join(cutoffs, queries["vec_id"] == cutoffs["query_id"]).select(
        "vec_id", "v", "cutoff", "qb", every_c
    )
    found = meet(
        bounded, candidates, keys, lambda q, c: _resolved(q, c, k),
        "query_id bigint, vec_id bigint, score bigint",
    )
    return ranked(found, k)
