"""What the operators share: texts in Arrow batches, and lookups with hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup keeps at most so many rows for keys with a large share of all rows.
HOT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(work: Callable[[list], pa.Array], returns: str, rows: int | None = None) -> Callable[..., Column]:
    """A column function: ``work`` turns the values of one Arrow batch into an array.

    With ``rows`` it gets so many values of the batch at a time, which bounds the texts that a
    worker holds as Python strings. Spark calls it once a row even where a filter stands on its result.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            step = rows or max(len(batch), 1)
            parts = [work(batch.slice(at, step).to_pylist()) for at in range(0, max(len(batch), 1), step)]
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()


class Memo(dict):
    """Results of ``make`` by key, for ``map(memo.__getitem__, keys)``.

    Holds two generations of at most ``most`` keys: what was used since the last change of
    generation survives the next one. Keys that are texts of over ``longest`` characters are not
    held, so that memory stays bounded whatever the texts are: a result is no larger than its key.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.before = make, most, longest, {}

    def __missing__(self, key):
        if type(key) is str and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        value = self.before.pop(key, self)
        if value is self:
            value = self.make(key)
        self[key] = value
        return value


class BySpace:
    """Encodes texts piece by piece between single spaces, with a memo of pieces.

    ``cut`` encodes any text, ``join`` puts encoded neighbours together. That is exact for
    patterns that start a match at a space after other characters and run over no other
    white space: each space with no white space beside it then begins a match. Texts with
    more white space than that go to ``cut`` as a whole.
    """

    def __init__(self, cut: Callable[[str], str | bytes], join: Callable, most: int):
        self.cut, self.join = cut, join
        self.piece = Memo(self._piece, most)

    def _piece(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self.cut(" " + piece)

    def encode(self, text: str):
        first, *rest = text.split(" ")
        if rest and not (first and first[-1].isspace()):
            try:
                tail = self.join(map(self.piece.__getitem__, rest))
                return self.join((self.cut(first), tail)) if first else tail
            except TypeError:  # None: a space beside white space
                pass
        return self.cut(text)


def lookup(
    left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "left"
) -> DataFrame:
    """``left`` joined to ``right``, which has one row a key, where keys of ``left`` may be hot.

    ``rows`` is a column of ``right`` with the number of rows of ``left`` that have the key,
    ``total`` the number of all rows of ``left``. At most HOT_ROWS keys can each have more than
    total / HOT_ROWS rows: these are broadcast, which this proves to be small. All others
    are joined by a shuffle in which no key is hot. ``left`` is read twice. ``how``: left or
    inner.
    """
    limit = max(1, total // HOT_ROWS)
    hot = F.broadcast(right.where(F.col(rows) > limit).drop(rows))
    cold = right.where(F.col(rows) <= limit).drop(rows)
    return left.join(hot, keys, "inner").unionByName(
        left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    )
