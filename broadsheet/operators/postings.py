"""Term frequencies per document and field, and tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import analyzed_pieces, is_stop_word, is_word
from ..schema import ID, SEARCH_FIELDS
from ..session import durable


def doc_terms(articles: DataFrame, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    """``(identifier, field, term, tf)`` over the analysed words of each field.

    All words of a field lie in one row, so nothing is shuffled: the words are sorted
    inside the row and the lengths of the runs of equal words are the frequencies. The tests on a
    word come after that, once for each different word, where they stay in generated code.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    per_field = articles.select(ID, F.inline(texts))
    ordered = per_field.select(ID, "field", F.sort_array(analyzed_pieces(F.col("text"))).alias("w"))
    ends = ordered.select(ID, "field", "w", _run_ends(F.col("w")).alias("ends"))
    counted = ends.select(ID, "field", F.inline(_runs(F.col("w"), F.col("ends"))))
    return counted.where(is_word(F.col("term")) & ~is_stop_word(F.col("term")))


def _run_ends(words: Column) -> Column:
    """Where each run of equal words ends, counted from 1."""
    places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(
        places, lambda i: (i == F.size(words)) | (F.get(words, i) != F.get(words, i - 1))
    )


def _runs(words: Column, ends: Column) -> Column:
    return F.transform(
        ends,
        lambda end, at: F.struct(
            F.get(words, end - 1).alias("term"),
            (end - F.coalesce(F.get(ends, at - 1), F.lit(0))).cast("bigint").alias("tf"),
        ),
    )


def terms_of(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """Term frequencies of the listed documents."""
    return terms.join(ids.select(ID), ID, "left_semi")


def vocabulary(terms: DataFrame) -> DataFrame:
    """Distinct words."""
    return terms.select("term").distinct()


def write_doc_terms(terms: DataFrame, path: str, files: int | None = None, by: str = "term") -> None:
    """Store term frequencies so that a lookup reads few row groups.

    They are sorted ``by`` word (``term``) or by document (``identifier``), and a Bloom filter of that
    column tells a row group without the value from one that only spans it. The range runs over
    word and document: a very frequent word or a very long document is cut into several files. The
    terms are stored first: the bounds of the ranges come from a pass of its own over them, which
    would cut all texts a second time.
    """
    terms = durable(terms)
    keys = ("term", ID) if by == "term" else (ID, "term")
    ranged = terms.repartitionByRange(files, *keys) if files else terms.repartitionByRange(*keys)
    bloom = {f"parquet.bloom.filter.enabled#{by}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").options(**bloom).parquet(path)


def term_counts(stored: DataFrame, words: list[str]) -> DataFrame:
    """``(term, documents, count)`` of some words from stored term frequencies.

    The words are a filter that reaches the scan; Spark pushes up to
    ``spark.sql.parquet.pushdown.inFilterThreshold`` of them one by one, and the span of more.
    """
    found = stored.where(F.col("term").isin(list(words)))
    return found.groupBy("term").agg(F.count_distinct(ID).alias("documents"), F.sum("tf").alias("count"))
