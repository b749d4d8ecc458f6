"""Language identification by string kernels.

A text becomes the set of its letter n-grams of one to ORDER characters (a blended spectrum,
presence only, hashed into BUCKETS). The kernel of two texts is the size of the intersection
over the root of the product of both sizes. Some training texts are landmarks; the Nystroem
map of a text is its kernel row to them, whitened; kernel ridge regression on that map has one
output a language (that one against the rest). The kernel is linear in the presence vector, so
the landmarks, the whitening and the weights are folded into one matrix, and a batch of texts
is scored by one product of its presence rows with it.

The outputs of one text always have the same sum, so the best of them cannot tell a text of no
learned language. For that the buckets known from training are kept: a text is familiar by the
share of its buckets that are known.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch

ORDER = 3
BUCKETS = 1 << 14
UNKNOWN = "und"
#: Characters turned into n-grams at once, and texts of one matrix product.
CHUNK, ROWS = 1 << 18, 128
#: Training rows, besides the text itself, that make a bucket known.
KNOWN_ROWS = 3

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: one in five, by their id. False where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def presence(text: str | None) -> np.ndarray | None:
    """Which buckets the n-grams of a whole text fill; None if it has no letter."""
    if not text:
        return None
    found = np.zeros(BUCKETS, bool)
    lower = text.lower()
    any_letter, after_letter, last = False, True, np.zeros(0, np.uint64)
    for at in range(0, len(lower), CHUNK):
        part = lower[at : at + CHUNK]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = _LETTER[codes.astype(np.int64)]
        any_letter |= bool(letter.any())
        codes = np.where(letter, codes, np.uint64(32))
        kept = codes[letter | np.r_[after_letter, letter[:-1]]]  # one blank between words
        after_letter = bool(letter[-1])
        # The last codes kept of the chunks before begin the n-grams that run over the cut.
        kept = np.concatenate([last, kept])
        last = kept[max(0, len(kept) - ORDER + 1) :]
        grams = np.zeros(len(kept), np.uint64)
        for order in range(1, min(ORDER, len(kept)) + 1):
            grams = grams[: len(kept) - order + 1] * np.uint64(1 << 21) + kept[order - 1 :]
            mixed = (grams + np.uint64(order)) * _SPREAD
            found[(mixed >> np.uint64(50)).astype(np.int64)] = True
    return found if any_letter else None


def scrambled(text: str | None) -> str | None:
    """The text with its letters dealt anew to the places of letters: junk as long, in its script."""
    if not text:
        return text
    chars = np.array(list(text.lower()))
    letters = np.flatnonzero([c.isalpha() for c in chars.tolist()])
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    chars[letters] = chars[rng.permutation(letters)]
    return "".join(chars.tolist())


@dataclass
class Model:
    """Languages, and the folded weights (one row a bucket, one column a language).

    ``known`` says which buckets training has filled, ``familiar`` from which share of known
    buckets a text is taken for one of the languages; 0 where training could not tell.
    """

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    known: np.ndarray | None = None
    familiar: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return (rows @ self.weights) / sizes + self.bias

    def predict(self, texts: list) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores and shares of known buckets."""
        found, score, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return found, score, known
        for at in range(0, len(texts), ROWS):
            bits = [(i, p) for i in range(at, min(at + ROWS, len(texts))) if (p := presence(texts[i])) is not None]
            if not bits:
                continue
            rows = np.array([p for _, p in bits])
            values = self.scores(rows.astype(np.float32))
            best = values.argmax(axis=1)
            if self.known is not None:
                for (i, _), share in zip(bits, known_share(rows, self.known)):
                    known[i] = float(share)
            for (i, _), row, c in zip(bits, values, best):
                found[i] = self.languages[c]
                score[i] = float(np.clip((row[c] + 1) / 2, 0, 1))
        return found, score, known


def known_share(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The share of known buckets of each presence row; one more counts, for short texts."""
    return ((rows & known).sum(axis=1) + 1) / (rows.sum(axis=1) + 1)


def familiarity(packed: np.ndarray, junk: np.ndarray) -> tuple[np.ndarray, float]:
    """The buckets known from packed training rows, and the least share of a familiar text.

    That is midway between the share that 19 in 20 training rows reach, each by what the others
    know, and the median share of their scrambled letters. If these are no better, it is 0.
    """
    blocks = lambda bits: (np.unpackbits(bits[at : at + ROWS], axis=1).astype(bool) for at in range(0, len(bits), ROWS))
    seen = sum((rows.sum(axis=0) for rows in blocks(packed)), np.zeros(BUCKETS, np.int64))
    known = seen >= KNOWN_ROWS
    if not len(packed) or not len(junk):
        return known, 0.0
    own = np.concatenate([known_share(rows, seen - rows >= KNOWN_ROWS) for rows in blocks(packed)])
    other = np.concatenate([known_share(rows, known) for rows in blocks(junk)])
    low, high = float(np.median(other)), float(np.quantile(own, 0.05))
    return known, (low + high) / 2 if low < high else 0.0


def _unit(packed: np.ndarray) -> np.ndarray:
    """Presence rows of length one from packed bits."""
    rows = np.unpackbits(packed, axis=1).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def fit_rows(packed: np.ndarray, labels: list[str], landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """One-versus-rest kernel ridge regression on the Nystroem map of packed presence rows.

    Rows are unpacked some at a time: all of them would be 64 kB each.

    The first rows of each language, in turns, are the landmarks. One language gives a model
    that always answers it; none gives a model that answers ``und``.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    kind = np.array([languages.index(x) for x in labels])
    turn = np.zeros(len(kind), np.int64)
    for c in range(len(languages)):
        turn[kind == c] = np.arange((kind == c).sum())
    chosen = np.lexsort((kind, turn))[:landmarks]
    marks = _unit(packed[chosen])
    parts = [_unit(packed[at : at + ROWS]) @ marks.T for at in range(0, len(packed), ROWS)]
    kernel = np.concatenate(parts).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    kept = values > 1e-8 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    mapped = kernel @ whiten
    target = np.where(kind[:, None] == np.arange(len(languages)), 1.0, -1.0)
    middle, level = mapped.mean(axis=0), target.mean(axis=0)
    centred = mapped - middle
    gram = centred.T @ centred + ridge * len(kind) * np.eye(centred.shape[1])
    beta = np.linalg.solve(gram, centred.T @ (target - level))
    return Model(
        languages,
        (marks.T @ (whiten @ beta)).astype(np.float32),
        (level - middle @ beta).astype(np.float32),
    )


def described(rows: DataFrame) -> DataFrame:
    """``doc_id, lang, bits, junk``: packed presence of each text and of its scrambled letters.

    One function makes both: two would need two Python workers a task, which then stay.
    """
    packed = lambda text: None if (p := presence(text)) is None else np.packbits(p).tobytes()

    def work(texts: list) -> pa.Array:
        made = [pa.array([packed(t) for t in side], pa.binary()) for side in (texts, map(scrambled, texts))]
        return pa.StructArray.from_arrays(made, ["bits", "junk"])

    both = per_batch(work, "struct<bits:binary,junk:binary>", ROWS)(F.col("text"))
    return rows.select("doc_id", "lang", both.alias("both")).select("doc_id", "lang", "both.bits", "both.junk")


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 4000,
    landmarks: int = 256,
) -> Model:
    """Learn from a sample of about ``sample_rows`` rows, the same number for each language.

    Rows with a label and an id that is not held out are drawn by a hash of their id. Only
    their presence bits and those of their scrambled letters (4 kB a row) go to the driver;
    twice ``sample_rows`` bounds them.
    """
    usable = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where(learnable("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return fit_rows(np.zeros((0, BUCKETS // 8), np.uint8), [])
    share = max(1, sample_rows // len(counts))
    drawn = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, share / n))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    rows = (
        described(usable.where(chance < F.try_element_at(drawn, F.col("lang"))))
        .limit(2 * sample_rows)
        .toPandas()
        .dropna(subset=["bits"])
        .sort_values(["doc_id", "lang", "bits"])
    )
    found, other = (
        np.array([np.frombuffer(b, np.uint8) for b in rows[c]], np.uint8).reshape(-1, BUCKETS // 8)
        for c in ("bits", "junk")
    )
    model = fit_rows(found, rows["lang"].tolist(), landmarks)
    model.known, model.familiar = familiarity(found, other)
    return model


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column (lang_pred, score from 0 to 1, known) for the texts of ``docs``.

    ``known`` is the share of the text's buckets that are known from training; below
    ``model.familiar`` the text is in none of the languages. ``und``, 0 and 0 for a text that is null or has no letter, and for all texts if there was
    nothing to learn from. Ties go to the first language by name. Whole texts count, whatever
    their length; rows do not depend on each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def work(texts: list) -> pa.Array:
        found, score, known = shared.value.predict(texts)
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())],
            ["lang_pred", "score", "known"],
        )

    return per_batch(work, "struct<lang_pred:string,score:double,known:double>", ROWS)(F.col(text))
