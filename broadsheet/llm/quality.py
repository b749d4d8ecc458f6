"""Quality scores by pairwise ranking (Bradley-Terry).

A text is described by its style: shares of kinds of characters, repetition, and how often its
words have each shape (letters in upper or lower case, digits, and which other characters). A
document of label 1 is preferred to one of label 0. The chance that a document is preferred to
another is the logistic function of the difference of their scores, a score is linear in the
features, and the logistic loss on differences of features of preference pairs gives the weights.
A quantile of the scores is the threshold: a text's result is its chance against a text there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import Memo, per_batch

SHAPES = 512
#: Steps of a style feature: one more feature says whether it is above each of these quantiles.
STEPS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
#: Words whose shape a Python worker keeps, and the longest ones kept.
WORDS, WORD_CHARS = 200_000, 64
#: Texts scored together.
ROWS = 512

_ALL = bytes(range(256))
_OF = lambda test: bytes(b for b in _ALL if test(chr(b)) and b < 128)
_UPPER, _LOWER, _DIGIT, _BLANK = _OF(str.isupper), _OF(str.islower), _OF(str.isdigit), _OF(str.isspace)
_OTHER = _OF(lambda c: not (c.isalnum() or c.isspace()))
STYLE = "upper lower digit blank other beyond_ascii distinct_words top_word word_size new_lines distinct_lines packed size".split()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the model does not learn from, by their id. False where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def shape(word: str) -> int:
    """The bucket of a word's shape: kinds of characters, of equal neighbours at most two."""
    made, last, run = [], "", 0
    for c in word[:WORD_CHARS]:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        run = run + 1 if kind == last else 1
        last = kind
        if run <= 2:
            made.append(kind)
    return zlib.crc32("".join(made).encode("utf-8", "surrogatepass")) % SHAPES


def style(text: str, words: list[str], counts: Counter) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    share = lambda kind: 1 - len(raw.translate(None, kind)) / size if raw else 0.0
    kinds = [share(k) for k in (_UPPER, _LOWER, _DIGIT, _BLANK, _OTHER)]
    lines = [x for x in text.split("\n") if x]
    return kinds + [
        1 - sum(kinds),
        len(counts) / max(1, len(words)),
        max(counts.values(), default=0) / max(1, len(words)),
        len(text) / max(1, len(words)),
        text.count("\n") / size,
        len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / size,
        float(np.log1p(len(raw))),
    ]


_SHAPE = Memo(shape, WORDS, WORD_CHARS)


def features(texts: list) -> np.ndarray:
    """One row a whole text: its style and the roots of the shares of its words' shapes."""
    out = np.zeros((len(texts), len(STYLE) + SHAPES), np.float32)
    for i, text in enumerate(texts):
        words = (text or "").split()
        counts = Counter(words)
        out[i, : len(STYLE)] = style(text or "", words, counts)
        if words:
            at = np.fromiter(map(_SHAPE.__getitem__, counts), np.int64, len(counts))
            often = np.fromiter(counts.values(), np.float64, len(counts))
            out[i, len(STYLE) :] = np.sqrt(np.bincount(at, often, SHAPES) / len(words))
    return out


@dataclass
class Model:
    """Weights over stepped features, and the threshold; ``always`` where nothing could be learned."""

    steps: np.ndarray  # a row a style feature: its quantiles
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    always: float | None = None

    def stepped(self, rows: np.ndarray) -> np.ndarray:
        own = rows[:, : len(STYLE)]
        above = (own[:, :, None] > self.steps[None]).reshape(len(rows), -1)
        return np.hstack([rows, above.astype(np.float32)])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Scores whose differences say which of two texts is preferred."""
        scaled = np.clip((self.stepped(rows) - self.middle) / self.spread, -4, 4)
        return scaled.astype(np.float64) @ self.weights

    def scores(self, texts: list) -> np.ndarray:
        if self.always is not None:
            return np.full(len(texts), self.always)
        parts = [self.raw(features(texts[at : at + ROWS])) for at in range(0, len(texts), ROWS)]
        return _logistic(np.concatenate(parts) - self.threshold) if parts else np.zeros(0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pair_gradient(weights: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float) -> np.ndarray:
    """Of the mean logistic loss over pairs of rows, plus ``ridge`` / 2 times the squared weights."""
    apart = better - worse
    pull = 1 - _logistic(apart @ weights)
    return -(pull.astype(apart.dtype) @ apart) / len(apart) + ridge * weights


def fit_rows(
    rows: np.ndarray, labels: np.ndarray, shares: np.ndarray, steps: int = 400, pairs: int = 512, ridge: float = 3e-3
) -> Model:
    """Fit to rows of ``features`` with labels 0 and 1; a row stands for ``shares`` rows.

    Each step draws ``pairs`` preference pairs. The threshold is the quantile of the scores below
    which the share of label 0 lies. With one label only there is no pair: the model then gives
    every text that label, and 0 if there is no row.
    """
    none = np.zeros(0)
    if len(set(labels.tolist())) < 2:
        return Model(none, none, none, none, always=float(labels.max(initial=0)))
    model = Model(np.quantile(rows[:, : len(STYLE)], STEPS, axis=0).T.astype(np.float32), 0.0, 1.0, none)
    wide = model.stepped(rows)
    model.middle, model.spread = wide.mean(axis=0), np.maximum(wide.std(axis=0), 0.02)
    wide = np.clip((wide - model.middle) / model.spread, -4, 4).astype(np.float32)
    rng = np.random.default_rng(11)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    weights, first, second = (np.zeros(wide.shape[1], np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        one, two = rng.choice(good, pairs), rng.choice(bad, pairs)
        gradient = pair_gradient(weights, wide[one], wide[two], ridge)
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        ahead = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights = weights - 0.02 * (1 - (step - 1) / steps) * ahead
    model.weights = weights.astype(np.float64)
    model.threshold = threshold(model.raw(rows), shares, float(shares[labels == 0].sum() / shares.sum()))
    return model


def threshold(scores: np.ndarray, shares: np.ndarray, share: float) -> float:
    """The quantile of weighted scores below which ``share`` of them lie, midway between two scores."""
    order = np.argsort(scores, kind="stable")
    below = np.cumsum(shares[order]) / shares.sum()
    at = min(int(np.searchsorted(below, share - 1e-9)), len(scores) - 2)
    return float((scores[order[at]] + scores[order[at + 1]]) / 2)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 8000,
) -> Model:
    """Learn from about ``sample_rows`` labelled rows, half of each label, drawn by a hash.

    Held-out and null ids are not used. The driver gets the features of the sample (2 kB a row,
    whatever the length of its text); twice ``sample_rows`` bounds it.
    """
    marks = labelled.marked(labels, label, ~held_out("id"), doc_id)
    described = per_batch(
        lambda texts: pa.array(list(features(texts)), pa.list_(pa.float32())), "array<float>"
    )
    own = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("text"))
    stored, part = labelled.sample(own, marks, described(F.col("text")), sample_rows, doc_id)
    found = stored.toPandas().sort_values(["id", "y"], kind="stable")
    if found.empty:
        return fit_rows(np.zeros((0, len(STYLE) + SHAPES), np.float32), np.zeros(0), np.zeros(0))
    y = found["y"].to_numpy().astype(np.float64)
    shares = np.array([1 / part[int(v)] for v in y])
    return fit_rows(np.stack(found["row"].to_numpy()).astype(np.float32), y, shares)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A double column from 0 to 1 for each whole text of ``docs``; from 0.5 on it is above the threshold.

    A null text scores as an empty one, which has features like any other. Very long texts
    take time in proportion to their length. Rows do not depend on each other, so ties, repeated rows
    and empty tables need no care, and no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    return per_batch(lambda texts: pa.array(shared.value.scores(texts), pa.float64()), "double")(F.col(text))
