"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector then goes down to one leaf. A query takes
nodes from a priority queue, the centre with the largest inner product first, and visits the
leaves as they come up. How many leaves it visits is calibrated: the visits are widened until
a sample of queries reaches the wanted recall against brute force over all vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .vectors import (
    best_of_block,
    best_of_matrix,
    best_pairs,
    by_length,
    matrix,
    meet,
    ranked,
    stored,
    together,
    usable,
    without_copies,
)

BRANCHES, ROUNDS = 16, 8
#: Vectors that the tree is fitted on, wanted rows of a leaf, and leaves at most. Where all
#: leaves are in use they only hold more rows: a leaf is searched in blocks, whatever its size.
SAMPLE, LEAF_ROWS, LEAVES = 20_000, 200, 4096
#: Queries for calibration, and their wanted recall.
TRIALS, RECALL = 200, 0.97
#: Queries and candidates of a block, and queries scored at once.
QUERIES, CANDIDATES, ROWS = 4096, 8192, 256


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: np.ndarray, leaf_rows: float, seed: int = 11) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)
        tree._grow(rows, max(leaf_rows, 2), rng)
        return tree

    def _grow(self, rows: np.ndarray, leaf_rows: float, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0))
        self.children.append([])
        if len(rows) > leaf_rows:
            many = int(min(BRANCHES, np.ceil(len(rows) / leaf_rows)))
            parts = _k_means(rows, max(2, many), rng)
            if len(parts) > 1:
                self.children[node] = [self._grow(rows[p], leaf_rows, rng) for p in parts]
        return node

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches by the nearest centre of every level."""
        at = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, members = todo.pop()
            own = self.children[node]
            if own and len(members):
                centres = np.array([self.centres[c] for c in own])
                near = (rows[members] @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
                todo += [(c, members[near == i]) for i, c in enumerate(own)]
            else:
                at[members] = node
        return at

    def visits(
        self, queries: np.ndarray, most: int, held: dict[int, int] | None = None, wanted: int = 0
    ) -> list[list[int]]:
        """The first ``most`` leaves for each query, best bin first.

        Goes on until the leaves hold ``wanted`` rows by the counts ``held``, or none is left.
        """
        held = held or {}
        weights = queries @ np.array(self.centres).T
        out = []
        for weight in -weights:
            heap, leaves, rows = [(weight[0], 0)], [], 0
            while heap and (len(leaves) < most or rows < wanted):
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(heap, (weight[child], child))
                else:
                    leaves.append(node)
                    rows += held.get(node, 0)
            out.append(leaves)
        return out

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Indices of the members of each cluster that is not empty."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        full = np.unique(near)
        centres = np.array([rows[near == c].mean(axis=0) for c in full])
    near = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    return [np.flatnonzero(near == c) for c in np.unique(near)]


def _sample(rows: DataFrame, number: int, most: int) -> pd.DataFrame:
    """About ``most`` rows, drawn by a hash of their id; twice as many bound them."""
    chance = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 31)) / float(1 << 31)
    drawn = rows.where(chance < min(1.0, most / max(1, number))).limit(2 * most)
    return drawn.select("vec_id", "v").toPandas().sort_values("vec_id")


def _brute_force(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` for a few queries against all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(), matrix(queries["v"])))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, asked = shared.value
        for frame in frames:
            if len(frame):
                ids = [np.asarray(i) for i in frame["ids"]]
                yield best_of_block(asked @ matrix(frame["v"]).T, own, ids, k)

    return ranked(rows.mapInPandas(score, "query_id bigint, vec_id bigint, score double"), k)


def calibrate(tree: Tree, placed: DataFrame, queries: pd.DataFrame, k: int, wanted: float) -> int:
    """The least number of leaf visits with which the queries find ``wanted`` of their true k."""
    if not len(queries):
        return 1
    truth = _brute_force(placed, queries, k).select("query_id", "vec_id")
    ids = placed.select(F.explode("ids").alias("vec_id"), "leaf")
    homes = ids.join(F.broadcast(truth), "vec_id").select("query_id", "leaf").toPandas()
    order = {
        q: {leaf: i + 1 for i, leaf in enumerate(leaves)}
        for q, leaves in zip(queries["vec_id"], tree.visits(matrix(queries["v"]), tree.leaves))
    }
    needed = np.sort([order[q][leaf] for q, leaf in zip(homes["query_id"], homes["leaf"])])
    if not len(needed):
        return 1
    return int(needed[int(np.ceil(wanted * len(needed))) - 1])


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # at most LEAVES leaves

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(leaf=shared.value.leaf_of(matrix(frame["v"])))

    return rows.mapInPandas(assign, "vec_id bigint, v array<double>, ids array<bigint>, leaf bigint")


def bins_of(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each leaf a bin of neighbouring leaves, and the blocks that the bin is cut into.

    A bin holds about CANDIDATES vectors in one block. A leaf of more is a bin of its own.
    """
    found, current, filled = {}, -1, CANDIDATES
    for leaf in sorted(counts):  # children have the numbers after their parent's
        blocks = -(-counts[leaf] // CANDIDATES)
        if filled + counts[leaf] > CANDIDATES:
            current, filled = current + 1, 0
        filled += counts[leaf]
        found[leaf] = (current, blocks)
    return found


def _visits(
    queries: DataFrame, tree: Tree, most: int, bins: dict[int, tuple[int, int]], held: dict[int, int], wanted: int
) -> DataFrame:
    """One row a query and bin, with the leaves of the bin that it visits.

    The leaves that a query visits hold at least ``wanted`` rows by the counts ``held``.
    """
    shared = queries.sparkSession.sparkContext.broadcast((tree, bins, held))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, bins, held = shared.value
        for frame in frames:
            rows = []
            leaves = tree.visits(matrix(frame["v"]), most, held, wanted) if len(frame) else []
            for query, vector, own in zip(frame["vec_id"], frame["v"], leaves):
                of: dict[tuple[int, int], list[int]] = {}
                for leaf in own:
                    if leaf in bins:  # a leaf of the sample alone holds nothing
                        of.setdefault(bins[leaf], []).append(leaf)
                rows += [(query, vector, bin_, blocks, found) for (bin_, blocks), found in of.items()]
            yield pd.DataFrame(rows, columns=["vec_id", "v", "bin", "blocks", "leaves"])

    return queries.mapInPandas(
        visit, "vec_id bigint, v array<double>, bin int, blocks int, leaves array<bigint>"
    )


def _block_scores(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of a block for each query, over all the leaves of it that it visits."""
    out = []
    if len(queries) and len(candidates):
        candidates = candidates.sort_values(["leaf", "vec_id"])
        b = matrix(candidates["v"])
        ids = [np.asarray(i) for i in candidates["ids"]]
        leaves, begins = np.unique(candidates["leaf"].to_numpy(), return_index=True)
        ends = np.append(begins[1:], len(b))
        for at in range(0, len(queries), ROWS):
            part = queries.iloc[at : at + ROWS]
            a = matrix(part["v"])
            sizes = part["leaves"].map(len).to_numpy()
            asks, asked = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["leaves"].to_list())
            pairs = []
            for leaf, begin, end in zip(leaves, begins, ends):
                own = asks[asked == leaf]
                if len(own):
                    row, col, value = best_of_matrix(a[own] @ b[begin:end].T, k)
                    pairs.append((own[row], begin + col, value))
            if pairs:
                row, col, value = (np.concatenate(p) for p in zip(*pairs))
                out.append(best_pairs(row, col, value, part["vec_id"].to_numpy(), ids, k))
    return together(out, {"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(
    table: DataFrame,
    k: int = 20,
    every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    wanted: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each id divisible by ``every``.

    Nearest is the largest inner product, of the original vectors in double precision; ties
    go to the smaller id. A row is no candidate for its own id. Copies of a vector share one
    entry of the index and are written out. Rows that take no part are those of
    ``vectors.usable`` and zero vectors. An empty table gives no rows. A query gets fewer than
    ``k`` rows only if there are fewer candidates: it visits leaves until they hold enough.
    Vectors meet those of their own length, in a tree of these alone.
    """
    rows = durable(usable(table, vec_id, vector, nonzero=True))
    return by_length(rows, lambda alike: _nearest(alike, k, every, wanted), k)


def _nearest(rows: DataFrame, k: int, every: int, wanted: float) -> DataFrame:
    spark = rows.sparkSession
    distinct, kinds = stored(without_copies(rows, k + 1))
    sample = _sample(distinct, kinds, SAMPLE)
    if not len(sample):
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).limit(0)
    leaves = min(LEAVES, max(1, kinds // LEAF_ROWS))
    tree = Tree.fit(matrix(sample["v"]), len(sample) / leaves)
    placed = durable(_assigned(distinct, tree))
    asked, questions = stored(rows.where(F.col("vec_id") % every == 0))
    most = calibrate(tree, placed, _sample(asked, questions, TRIALS), k, wanted)
    per_leaf = placed.groupBy("leaf").agg(F.count(F.lit(1)), F.sum(F.size("ids"))).collect()  # a row a leaf
    counts, held = {leaf: n for leaf, n, _ in per_leaf}, {leaf: n for leaf, _, n in per_leaf}
    bins = bins_of(counts)
    # Of 2 k rows, k at most are the query's own: without_copies keeps an id k times at most.
    visits = durable(_visits(asked, tree, most, bins, held, 2 * k))
    # How many blocks of queries each bin meets: a row a bin.
    demand = durable(visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qs")))
    number = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")
    every_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    homes = F.broadcast(
        spark.createDataFrame([(leaf, *at) for leaf, at in bins.items()], "leaf bigint, bin int, blocks int")
    )
    candidates = placed.join(homes, "leaf").join(F.broadcast(demand), "bin").select(
        "vec_id", "v", "ids", "leaf", "bin", number("blocks").alias("cb"), every_of("qs").alias("qb")
    )
    queries = visits.join(F.broadcast(demand), "bin").select(
        "vec_id", "v", "leaves", "bin", number("qs").alias("qb"), every_of("blocks").alias("cb")
    )
    found = meet(
        queries, candidates, ["bin", "qb", "cb"], lambda q, c: _block_scores(q, c, k),
        "query_id bigint, vec_id bigint, score double",
    )
    return ranked(found, k)
