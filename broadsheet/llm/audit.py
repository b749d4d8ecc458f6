"""How far the word use of the sources of a language lies apart.

Terms are counted by single-pass in-memory indexing. A task adds the terms of its documents to an
index in memory (documents a term, and occurrences a term and source) until the index is full, and
spills it as a run sorted by term, cut into pages for hash shards. The task of a shard merges
the runs with a heap and gives each term's frequencies. A source's chance of a term that it does
not hold depends on the source alone, so a pair of sources has a sum that assumes no term in
either, and is corrected by the terms that one of them holds (by their counts, of which there
are few) and by those that both hold (streamed, added up in memory).
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: An index in memory is full with so many terms of documents, or after so many bytes of text.
ENTRIES, TEXT_BYTES = 2_000_000, 32 << 20
#: Bytes of text added at once, terms of a page of a run, and pages of an Arrow batch.
CHUNK_BYTES, PAGE, BATCH = 4 << 20, 256, 256
#: Rows of other Arrow batches.
ROWS = 2000
#: Pairs of sources are added up in square tiles of this side, so many at once.
SIDE, TILES = 256, 64

#: Fixed value: a chance is a whole number of these parts.
PARTS = 1_000_000_000

PAGE_SCHEMA = (
    "shard int, lang string, first binary, terms array<binary>, docs array<bigint>, "
    "sizes array<int>, names array<string>, sources array<int>, counts array<bigint>"
)
TERM_SCHEMA = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"

# Every byte to itself, letters A to Z to lower case, and all that ends a term to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Index:
    """Block postings of one task: for each term of a document its group, and how often it occurs."""

    def __init__(self, shards: int, entries: int = ENTRIES, text_bytes: int = TEXT_BYTES):
        self.shards, self.entries, self.text_bytes = shards, entries, text_bytes
        self._clear()

    def _clear(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # groups, terms, occurrences
        self.size = self.seen = 0

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        """Add some documents, so few that their words fit into memory."""
        for lang in langs:
            self.langs.setdefault(lang, len(self.langs))
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        cut = pc.split_pattern(pa.array([t.translate(_FOLD) for t in texts], pa.large_binary()), b" ")
        doc = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy(zero_copy_only=False))
        words = cut.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        own = np.array([self.terms.setdefault(t, len(self.terms)) if t else -1 for t in names], np.int64)
        which, found = pd.factorize(doc * max(1, len(names)) + words.indices.to_numpy())
        often = np.bincount(which, minlength=len(found))
        of, term = found // max(1, len(names)), own[found % max(1, len(names))]
        real = term >= 0  # not what stands between two blanks
        self.postings.append((group[of][real], term[real], often[real]))
        self.size += int(real.sum())
        self.seen += sum(map(len, texts))

    def full(self) -> bool:
        return self.seen >= self.text_bytes or self.size >= self.entries

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The index as a run: pages of neighbouring terms for each language and shard."""
        groups, held, often = (np.concatenate(x) for x in zip(*self.postings)) if self.postings else ([], [], [])
        if len(held):
            yield from self._pages(groups, held, often)
        self._clear()

    def _pages(self, groups: np.ndarray, held: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, shards, many = len(self.terms), self.shards, len(self.groups)
        terms = pa.array(self.terms, pa.binary())
        order = pc.array_sort_indices(terms).to_numpy()
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        place = np.fromiter(map(crc32, self.terms), np.int64, n) % shards * n + rank
        lang_of = np.array([self.langs[lang] for lang, _ in self.groups], np.int64)
        # A row is a term of a language, a posting a group of such a row.
        rows, docs = np.unique(lang_of[groups] * (shards * n) + place[held], return_counts=True)
        keys = (lang_of[groups] * (shards * n) + place[held]) * many + groups
        by_key = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[by_key], prepend=-1))
        counts, keys = np.add.reduceat(often[by_key], first), keys[by_key][first]
        sizes = np.diff(np.append(np.searchsorted(keys, rows * many), len(keys)))
        sorted_terms = terms.take(pa.array(order[rows % n]))
        part = rows // n
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        within = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
        starts = np.flatnonzero(within % PAGE == 0)
        ends = np.append(starts, len(rows))
        posted = np.append(0, np.cumsum(sizes))[ends]
        names = np.array([source for _, source in self.groups], object)
        local = [np.unique(keys[i:j] % many, return_inverse=True) for i, j in zip(posted[:-1], posted[1:])]
        langs = list(self.langs)
        lists = lambda offsets, values, kind: pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(values, kind))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(part[starts] % shards, pa.int32()),
                pa.array([langs[i] for i in part[starts] // shards], pa.string()),
                sorted_terms.take(pa.array(starts)),
                lists(ends, sorted_terms, pa.binary()),
                lists(ends, docs, pa.int64()),
                lists(ends, sizes, pa.int32()),
                pa.array([names[u].tolist() for u, _ in local], pa.list_(pa.string())),
                lists(posted, np.concatenate([at for _, at in local]), pa.int32()),
                lists(posted, counts, pa.int64()),
            ],
            schema=_arrow(PAGE_SCHEMA),
        )
        for at in range(0, out.num_rows, BATCH):
            yield out.slice(at, BATCH)


def _record_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _record_batch(held, schema)
            held = []
    if held:
        yield _record_batch(held, schema)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    parts = [f.strip().split(" ") for f in schema.split(", ")]
    kind = lambda k: pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]
    return pa.schema([(name, kind(k)) for name, k in parts])


def runs(docs: DataFrame, shards: int, entries: int = ENTRIES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Pages of the runs of ``docs`` (lang, source, text, none of them null)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shards, entries, text_bytes)
        for chunk in _chunks(batches, min(CHUNK_BYTES, text_bytes)):
            index.add(*chunk)
            if index.full():
                yield from index.spill()
        yield from index.spill()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(build, PAGE_SCHEMA)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list, list]]:
    chunk: tuple[list, list, list] = ([], [], [])
    size = 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = row[2].as_py()
            for values, value in zip(chunk, (row[0], row[1], text)):
                values.append(value)
            size += len(text) + 1
            if size >= most:
                yield chunk
                chunk, size = ([], [], []), 0
    if chunk[0]:
        yield chunk


class Page:
    """A page of a run as the merge reads it; the columns are those of its Arrow batch."""

    __slots__ = ("lang", "shard", "terms", "docs", "at", "end", "begin", "names", "sources", "counts")

    def postings(self, i: int) -> Iterator[tuple[str, int]]:
        part = slice(self.begin[i], self.begin[i + 1])
        return zip(map(self.names.__getitem__, self.sources[part].tolist()), self.counts[part].tolist())


def read_pages(batch: pa.RecordBatch) -> Iterator[Page]:
    column = dict(zip(batch.schema.names, batch.columns))
    terms = column["terms"].flatten().to_pylist()
    docs = column["docs"].flatten().to_pylist()
    sizes, sources, counts = (column[c].flatten().to_numpy() for c in ("sizes", "sources", "counts"))
    begin = np.append(0, np.cumsum(sizes, dtype=np.int64))
    at = 0
    rows = zip(column["shard"].to_pylist(), column["lang"].to_pylist(), column["names"].to_pylist())
    for (shard, lang, names), size in zip(rows, column["terms"].value_lengths().to_pylist()):
        page = Page()
        page.shard, page.lang, page.names = shard, lang, names
        page.terms, page.docs, page.begin, page.sources, page.counts = terms, docs, begin, sources, counts
        page.at, page.end = at, at + size
        at += size
        yield page


def merged(pages: Iterator[Page], least_docs: int) -> Iterator[tuple]:
    """Rows of TERM_SCHEMA for the terms in at least ``least_docs`` documents.

    Pages come sorted by shard, language and first term. A page joins the heap when its first
    term is next, so the heap holds one page a run and not the runs.
    """

    def row(lang: str, term: bytes, docs: int, held: list[tuple[Page, int]]) -> tuple:
        counts: Counter = Counter()
        for page, i in held:
            for source, n in page.postings(i):
                counts[source] += n
        return lang, term.decode(), docs, list(counts), list(counts.values())

    for (_, lang), own in groupby(pages, lambda p: (p.shard, p.lang)):
        heap: list[tuple[bytes, int]] = []  # the next term of each page, and the page's number
        opened: dict[int, Page] = {}
        now, total, held = None, 0, []
        coming, number = next(own, None), 0
        while heap or coming is not None:
            while coming is not None and (not heap or coming.terms[coming.at] <= heap[0][0]):
                heapq.heappush(heap, (coming.terms[coming.at], number))
                opened[number] = coming
                coming, number = next(own, None), number + 1
            term, which = heap[0]
            page = opened[which]
            i = page.at
            page.at = i + 1
            if i + 1 < page.end:
                heapq.heapreplace(heap, (page.terms[i + 1], which))
            else:
                heapq.heappop(heap)
                del opened[which]
            if term != now:
                if total >= least_docs:
                    yield row(lang, now, total, held)
                now, total, held = term, 0, []
            total += page.docs[i]
            held.append((page, i))
        if total >= least_docs:
            yield row(lang, now, total, held)


def frequencies(docs: DataFrame, least_docs: int, shards: int | None = None, **index: int) -> DataFrame:
    """``lang, term, docs, sources, counts``: the kept terms, with the occurrences in each source.

    ``shards`` (by default the number of shuffle partitions) is how many tasks merge.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs(docs, shards, **index).repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first")
    out = _arrow(TERM_SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = (page for batch in batches for page in read_pages(batch))
        yield from _record_batches(merged(pages, least_docs), out)

    return dealt.mapInArrow(merge, TERM_SCHEMA)


def chance(count: Column, total: Column, terms: Column) -> Column:
    """Parts of a smoothed chance, exactly: counts may be too large for 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(count) + wide(F.lit(2))) * F.lit(PARTS).cast("decimal(10,0)")
    below = wide(total) + wide(F.lit(2)) * wide(terms)
    return F.lit(1).cast("bigint") + F.call_function("div", above, below)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Tiles:
    """Sums over pairs of places, in square tiles of memory; full ones are given away."""

    def __init__(self, side: int = SIDE, most: int = TILES):
        self.side, self.most = side, most
        self.held: dict[tuple, np.ndarray] = {}

    def add(self, lang: str, at: np.ndarray, value) -> Iterator[tuple]:
        """Add ``value(i, j)`` for all pairs of the sorted places ``at``, i and j slices of them."""
        cuts = np.flatnonzero(np.diff(at // self.side)) + 1
        parts = [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)])]
        for n, one in enumerate(parts):
            for two in parts[n:]:
                i, j = int(at[one.start]) // self.side, int(at[two.start]) // self.side
                tile = self.held.get((lang, i, j))
                if tile is None:
                    if len(self.held) >= self.most:
                        yield from self.rows()
                    tile = self.held[lang, i, j] = np.zeros((self.side, self.side), np.int64)
                tile[np.ix_(at[one] % self.side, at[two] % self.side)] += value(one, two)

    def rows(self) -> Iterator[tuple]:
        """``lang, one, two, value`` with one < two; the tiles are empty afterwards."""
        for (lang, i, j), tile in self.held.items():
            for a, b in zip(*(x.tolist() for x in np.nonzero(tile))):
                one, two = i * self.side + a, j * self.side + b
                if one < two:
                    yield lang, one, two, int(tile[a, b])
        self.held.clear()


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PAIR_SCHEMA = "lang string, one bigint, two bigint, value bigint"


def both_held(terms: DataFrame) -> DataFrame:
    """For pairs of sources, the correction by the terms that both hold, added up in each task.

    ``terms`` has a row a language and term with ``held``: ``at, p, bare`` of each source that
    has the term, ``bare`` being its chance of a term that it does not have.
    """
    out = _arrow(PAIR_SCHEMA)

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            tiles = Tiles()
            for batch in batches:
                for lang, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                    at, p, bare = (held.values.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                    order = np.argsort(at)
                    at, p, bare = at[order], p[order], bare[order]

                    def value(i: slice, j: slice) -> np.ndarray:
                        one, two = np.append(p[i], bare[i]), np.append(p[j], bare[j])
                        n, m = len(one) // 2, len(two) // 2
                        f = _apart(one[:, None], two)
                        return f[:n, :m] - f[:n, m:] - f[n:, :m] + f[n:, m:]

                    yield from tiles.add(lang, at, value)
            yield from tiles.rows()

        yield from _record_batches(rows(), out)

    added = terms.select("lang", "held").mapInArrow(correct, PAIR_SCHEMA)
    return added.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = 10,
    top: int = 10,
    shards: int | None = None,
    **index: int,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and the top terms of each.

    Nulls count as empty texts. Part ``pair`` has a row for every other source of the language,
    by falling divergence, part ``term`` the ``top`` terms that the source has more than its
    language. Ties go by the bytes of ``item``. Rows are documents, also repeated ones; only the
    three columns named are read; whole texts count, however long. A language without kept terms
    has value 0 for all pairs, and one source alone has no rows. An empty table gives no rows.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).alias("text"))
    terms = durable(frequencies(named, least_docs, shards, **index))
    of = Window.partitionBy("lang").orderBy("source")
    places = named.groupBy("lang", "source").agg(F.lit(1)).select(
        "lang", "source", (F.row_number().over(of) - 1).cast("bigint").alias("at")
    )
    posted = terms.select("lang", "term", F.inline(F.arrays_zip("sources", "counts"))).withColumnsRenamed(
        {"sources": "source", "counts": "n"}
    )
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    total = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    groups = durable(
        places.join(total, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .withColumns({"total": F.coalesce("total", none), "kept": F.coalesce("kept", none)})
        .withColumn("bare", F.when(F.col("kept") > 0, chance(none, F.col("total"), F.col("kept"))))
    )
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("kept").alias("lang_kept"))
    of_term = F.aggregate("counts", none, lambda a, n: a + n)
    with_lang = (
        terms.join(langs, "lang")
        .withColumn("q", chance(of_term, F.col("lang_total"), F.col("lang_kept")))
        .select("lang", "term", "q", F.inline(F.arrays_zip("sources", "counts")))
        .withColumnsRenamed({"sources": "source", "counts": "n"})
    )
    chances = durable(
        with_lang.join(groups, ["lang", "source"])
        .withColumn("p", chance(F.col("n"), F.col("total"), F.col("kept")))
        .select("lang", "term", "source", "at", "p", "q", "bare")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = chances.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        distance(F.col("p"), F.col("q")).alias("value"),
    )
    ranked = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = _pairs(groups, chances).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(ranked)


def _pairs(groups: DataFrame, chances: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every source and other source of its language."""
    held = F.collect_list(F.struct("at", "p", "bare")).alias("held")
    shared = both_held(chances.groupBy("lang", "term").agg(held))
    # How often a source has each chance: few rows, since few counts are different.
    levels = chances.groupBy("lang", "at", "bare", "p").agg(F.count(F.lit(1)).alias("often"))
    other = groups.select("lang", F.col("at").alias("to"), F.col("bare").alias("to_bare"))
    further = distance(F.col("p"), F.col("to_bare")) - distance(F.col("bare"), F.col("to_bare"))
    by_one = (
        levels.join(other, "lang")
        .where(F.col("at") != F.col("to"))
        .groupBy("lang", F.least("at", "to").alias("one"), F.greatest("at", "to").alias("two"))
        .agg(F.sum(F.col("often") * further).alias("value"))
    )
    left = groups.select("lang", "source", F.col("at").alias("one"), "bare", "kept")
    right = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("two"), F.col("bare").alias("b"))
    base = F.coalesce(F.col("kept") * distance(F.col("bare"), F.col("b")), F.lit(0).cast("bigint"))
    every = left.join(right, "lang").where(F.col("one") < F.col("two"))
    assumed = every.select("lang", "source", "item", "one", "two", base.alias("value"))
    corrections = by_one.unionByName(shared).groupBy("lang", "one", "two").agg(F.sum("value").alias("more"))
    summed = assumed.join(corrections, ["lang", "one", "two"], "left").withColumn(
        "value", F.col("value") + F.coalesce("more", F.lit(0).cast("bigint"))
    )
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return summed.select("lang", "value", F.inline(both))
