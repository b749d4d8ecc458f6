"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words, hashed. The machine adds a weight a term and, for every pair
of terms in the text, the product of their factors, so that two terms can mean more together
than each alone. Its sums over all pairs cost no more than sums over terms.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import Memo, per_batch
from .language import learnable

BUCKETS = 1 << 20
FACTORS = 8
#: Terms kept by the memo of a Python worker, and texts scored together.
TERMS, ROWS = 200_000, 256

_words = re.compile(r"\w+").findall


def terms(text: str | None) -> set[str]:
    return set(_words(text.lower())) if text else set()


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Model:
    """Buckets with weights (sorted), their weights and factors, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def __post_init__(self):
        self.memo = Memo(self._place, TERMS)
        self.own = (self.factors**2).sum(axis=1)

    @cached_property
    def known(self) -> dict[int, int]:
        """The place of each bucket, for looking at a model; scoring searches the sorted buckets."""
        return dict(zip(self.buckets.tolist(), range(len(self.buckets))))

    def _place(self, term: str) -> int:
        """Which of the buckets a term has, or -1."""
        wanted = bucket(term)
        at = int(np.searchsorted(self.buckets, wanted))
        return at if at < len(self.buckets) and self.buckets[at] == wanted else -1

    def __reduce__(self):
        return Model, (self.buckets, self.weights, self.factors, self.bias)

    def scores(self, texts: list) -> np.ndarray:
        out = []
        for at in range(0, len(texts), ROWS):
            rows = [[i for i in map(self.memo.__getitem__, terms(t)) if i >= 0] for t in texts[at : at + ROWS]]
            out.append(self.logits([sorted(r) for r in rows]))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30))) if out else np.zeros(0)

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        """Of lists of indices into ``buckets``."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        return self.bias + _sums(self.weights[flat], sizes) + 0.5 * (
            (_sums(self.factors[flat], sizes) ** 2).sum(axis=1) - _sums(self.own[flat], sizes)
        )


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, 0 for an empty run."""
    out = np.zeros((len(sizes),) + values.shape[1:])
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.cumsum(sizes) - sizes
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def evidence(cols: np.ndarray, of: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """By how many standard errors each term's shares of both labels differ."""
    ones, zeros = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    seen = np.bincount(cols)
    in_ones = np.bincount(cols, weights=labels[of])
    rate = seen / (ones + zeros)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / ones + 1 / zeros))
    return np.abs(in_ones / ones - (seen - in_ones) / zeros) / error


def gradient(
    weights: np.ndarray, factors: np.ndarray, bias: float, cols: np.ndarray, sizes: np.ndarray,
    labels: np.ndarray, shares: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the weighted mean log loss, for some rows whose terms are ``cols``, ``sizes`` to a row."""
    of = factors[cols]
    sums = _sums(of, sizes).astype(np.float32)
    pairs = 0.5 * ((sums**2).sum(axis=1) - _sums((of**2).sum(axis=1), sizes))
    logit = bias + _sums(weights[cols], sizes) + pairs
    delta = (shares * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(sizes)).astype(np.float32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    own = np.bincount(cols, delta[row], len(weights)).astype(np.float32)
    pulled = delta[:, None] * sums
    parts = [np.bincount(cols, pulled[row, f], len(weights)) for f in range(factors.shape[1])]
    return own, np.stack(parts, axis=1).astype(np.float32) - factors * own[:, None], float(delta.sum())


class Adam:
    """Steps for some places of an array at a time."""

    def __init__(self, shape: tuple, rate: float):
        self.first, self.second, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate

    def step(self, at, gradient, number: int, slower: float):
        first = self.first[at] = 0.9 * self.first[at] + 0.1 * gradient
        second = self.second[at] = 0.999 * self.second[at] + 0.001 * gradient * gradient
        ahead = (first / (1 - 0.9**number)) / (np.sqrt(second / (1 - 0.999**number)) + 1e-6)
        return self.rate * slower * ahead


def fit_rows(
    rows: list[np.ndarray],
    labels: np.ndarray,
    weights: np.ndarray,
    rounds: int = 20,
    batch: int = 128,
    ridge: float = 4e-3,
    apart: float = 3.5,
    factor_ridge: float = 0.06,
) -> Model:
    """Fit a weight and factors for every term of the rows, by Adam on mini-batches of the log loss.

    Rows are distinct buckets; no term is left out. ``ridge`` holds the weights down, and less so the
    more a term tells the labels apart alone (from about ``apart`` standard errors on). What
    pairs add must be stronger than ``factor_ridge``, or it fades: the many chance pairs of a
    text are not learned by heart. Memory is in proportion to the terms of all rows, whose number
    the caller bounds. Without both labels the model gives every text the share of label 1 (0 if
    there is no row at all).
    """
    empty = Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), -30.0)
    if not len(rows):
        return empty
    prior = float((labels * weights).sum() / weights.sum())
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    found, cols = np.unique(np.concatenate(rows), return_inverse=True)
    if not len(found) or prior in (0.0, 1.0):
        empty.bias = bias
        return empty
    cols = cols.astype(np.int32)
    sizes = np.array([len(r) for r in rows])
    starts = np.cumsum(sizes) - sizes
    seen = np.bincount(cols)
    often = np.minimum(1, seen * min(batch, len(rows)) / len(rows)).astype(np.float32)
    told = evidence(cols, np.repeat(np.arange(len(rows)), sizes), labels)
    # A term is only touched in the batches that have it, so its ridge is as much larger there.
    weight_ridge = (ridge / (1 + (told / apart) ** 8) / often).astype(np.float32)
    pair_ridge = (factor_ridge / often).astype(np.float32)[:, None]
    rng = np.random.default_rng(7)
    w = np.zeros(len(found), np.float32)
    v = rng.normal(0, 0.02, (len(found), FACTORS)).astype(np.float32)
    steps = Adam(w.shape, 0.05), Adam(v.shape, 0.02), Adam((1,), 0.05)
    shares = weights / weights.mean()
    total, number = rounds * -(-len(rows) // batch), 0
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at : at + batch]
            of = sizes[pick]
            places = np.repeat(starts[pick] - (np.cumsum(of) - of), of) + np.arange(of.sum())
            used, here = np.unique(cols[places], return_inverse=True)
            own, pair, shift = gradient(w[used], v[used], bias, here, of, labels[pick], shares[pick])
            number += 1
            slower = 1 - (number - 1) / total
            w[used] -= steps[0].step(used, own + weight_ridge[used] * w[used], number, slower)
            v[used] -= steps[1].step(used, pair + pair_ridge[used] * v[used], number, slower)
            bias -= float(steps[2].step(slice(None), np.float32(shift), number, slower)[0])
    return Model(found.astype(np.int64), w.astype(np.float64), v.astype(np.float64), bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 8000,
    sample_terms: int = 2_000_000,
) -> Model:
    """Learn from labelled rows, half of each label, drawn by a hash and weighted back to the true shares.

    There are about ``sample_rows`` of them (twice as many at most), and their distinct hashed terms,
    all that goes to the driver, are at most ``sample_terms`` together: each label has half of
    them, and its rows count in the order of their hash until that is full. So the driver
    holds a bounded number of bytes whatever the texts are. Held-out ids, null ids and null
    labels are not used; an id with several labels is toxic if one of them is.
    """
    hashed = per_batch(
        lambda texts: pa.array([sorted({bucket(w) for w in terms(t)}) for t in texts], pa.list_(pa.int32())),
        "array<int>",
    )
    own = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("text"))
    marks = labelled.marked(labels, label, learnable("id"), doc_id)
    stored, part = labelled.sample(own, marks, hashed(F.col("text")), sample_rows, doc_id)
    sizes = stored.select("y", "chance", F.size("row").alias("size")).toPandas().sort_values("chance", kind="stable")
    upto = {}
    for y, of in sizes.groupby("y"):
        inside = of["size"].cumsum() <= sample_terms // 2
        if not inside.all():  # the first row that does not fit, and rows of the same hash, stay out
            upto[y] = float(of["chance"][~inside].min())
            part[y] = min(part[y], upto[y])
    kept = F.lit(True)
    for y, chance in upto.items():
        kept &= (F.col("y") != int(y)) | (F.col("chance") < chance)
    rows = stored.where(kept).select("id", "y", "row").toPandas().sort_values(["id", "y"], kind="stable")
    y = rows["y"].to_numpy().astype(np.float64)
    weights = np.array([1 / part[int(v)] for v in y])
    return fit_rows([np.asarray(r, np.int64) for r in rows["row"]], y, weights)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A double column from 0 to 1: how likely label 1 is for each whole text of ``docs``.

    A null text scores as an empty one, which has no terms and gets the score of the bias.
    Terms that were not learned add nothing; repeated terms count once; rows do not depend on
    each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    return per_batch(lambda texts: pa.array(shared.value.scores(texts), pa.float64()), "double", ROWS)(F.col(text))
