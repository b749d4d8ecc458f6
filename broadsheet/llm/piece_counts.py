"""Token counts by a sentencepiece BPE model, without ids.

Pieces never run across a border between another character and a space, so a text falls
into pre-tokens (spaces, then what follows them) that are encoded apart. Each distinct
pre-token of a block of documents is counted once; a document's count is the sum of those
counts, each times its frequency in the document.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import batched

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, SparkSession
from sentencepiece import sentencepiece_model_pb2

from .common import per_batch

SPACE = "▁"  # how a model writes a space
#: Pre-tokens kept by a Python worker, and texts taken together.
KNOWN, BLOCK = 400_000, 256


class Counts:
    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        spec = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        plain = (
            spec.name == "identity"
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces
        )
        if not (apart and plain):
            raise ValueError("the model's pieces do not end where words end")
        self.pretokens = regex.compile(rf"[ {SPACE}]+[^ {SPACE}\n]*|\n[^ {SPACE}\n]*").findall
        self.known: dict[str, int] = {}  # what follows one space
        self.base = len(self.model.encode("a"))

    def _frequencies(self, text: str) -> Counter:
        """Of pre-tokens that follow one space, without it. A longer run stays with its text."""
        pieces = text.split(" ")
        if SPACE in text or "" in pieces:
            pieces = [
                p[1:] if p[0] == " " and p[1:2] not in ("", " ", SPACE) and "\n" not in p else (p,)
                for p in self.pretokens(" " + text)
            ]
        return Counter(pieces)

    def _learn(self, pieces: list) -> None:
        """Encode each distinct pre-token of ``pieces`` once."""
        cut = [p if type(p) is tuple else self.pretokens(" " + p) for p in pieces]
        distinct = list({p for ps in cut for p in ps})
        # A letter before it keeps the model from adding another space.
        ids = self.model.encode(["a" + p for p in distinct], num_threads=1)
        count = {p: len(i) - self.base for p, i in zip(distinct, ids)}
        self.known.update((p, sum(map(count.__getitem__, ps))) for p, ps in zip(pieces, cut))

    def of(self, texts: list) -> list[int]:
        out = []
        for block in batched(texts, BLOCK):
            found = [self._frequencies(t) if t else {} for t in block]
            if len(self.known) > KNOWN:
                self.known.clear()
            known = self.known
            self._learn(list({p for f in found for p in f if p not in known}))
            out += [sum([n * known[p] for p, n in f.items()]) for f in found]
        return out


_COUNTS: dict[str, Counts] = {}


def token_counts(spark: SparkSession, text: Column, path: str) -> Column:
    """The number of tokens of each text, without begin or end tokens.

    The model file is read on the driver and broadcast (half a MB, whatever the data). A null
    text counts as an empty one, which has no tokens. Special strings inside a text are
    ordinary text. Rows do not depend on each other, and an empty table stays empty.
    """
    with open(path, "rb") as file:
        model = file.read()
    key = hashlib.sha256(model).hexdigest()
    shared = spark.sparkContext.broadcast(model)

    def work(texts: list) -> pa.Array:
        if key not in _COUNTS:
            _COUNTS[key] = Counts(shared.value)
        return pa.array(_COUNTS[key].of(texts), pa.int64())

    return per_batch(work, "bigint")(text)
