"""Word counts, top words and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import (
    analyzed_pieces,
    is_stop_word,
    is_word,
    joined,
    raw_pieces,
    stripped_pieces,
    stripped_tokens,
)
from ..schema import CLOUD_FIELDS

TOKENISERS = ("raw", "stripped", "analyzed")


def term_rows(
    articles: DataFrame,
    fields: tuple[str, ...] = CLOUD_FIELDS,
    tokeniser: str = "stripped",
    min_length: int = 1,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per word occurrence, with the columns in ``keep``.

    The tests on a word come after the explode, where they stay in generated code.
    """
    text = joined(*fields)
    pieces = {"raw": raw_pieces, "stripped": stripped_pieces, "analyzed": analyzed_pieces}
    word = F.col("term")
    test = F.length(word) >= max(min_length, 1)
    if tokeniser == "analyzed":
        test = test & is_word(word) & ~is_stop_word(word)
    return articles.select(*keep, F.explode(pieces[tokeniser](text)).alias("term")).where(test)


def word_counts(
    articles: DataFrame,
    fields: tuple[str, ...] = CLOUD_FIELDS,
    tokeniser: str = "stripped",
    min_length: int = 1,
) -> DataFrame:
    """``(term, count)``. Counts are added up per task before the shuffle."""
    rows = term_rows(articles, fields, tokeniser, min_length)
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def top_terms(counts: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` most frequent words; equal counts are ordered by word."""
    return counts.orderBy(F.desc("count"), "term").limit(k)


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Add up several ``(term, count)`` tables."""
    merged = parts[0].select("term", "count")
    for part in parts[1:]:
        merged = merged.unionByName(part.select("term", "count"))
    return merged.groupBy("term").agg(F.sum("count").alias("count"))


def token_count(fields: tuple[str, ...] = CLOUD_FIELDS) -> Column:
    """Words of one article, of any length, over its fields."""
    return F.size(stripped_tokens(joined(*fields))).cast("bigint")


def _totals(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.coalesce(F.sum(token_count()), F.lit(0)).alias("words"),
        F.count(F.lit(1)).alias("docs"),
    )


def corpus_stats(articles: DataFrame) -> DataFrame:
    """Two rows: the number of words and of documents."""
    pairs = F.array(
        F.struct(F.lit("nrWords").alias("key"), F.col("words").alias("value")),
        F.struct(F.lit("nrDocs").alias("key"), F.col("docs").alias("value")),
    )
    return _totals(articles).select(F.inline(pairs))


def average_words(articles: DataFrame) -> DataFrame:
    """Words per document; null for no documents."""
    mean = F.try_divide(F.col("words").cast("double"), F.col("docs").cast("double"))
    return _totals(articles).select(mean.alias("words_per_doc"))


def articles_per_source(articles: DataFrame, source: str = "zipfilename") -> DataFrame:
    """``source, articles, total``: each input file, and all of them in a row where total is true."""
    counted = articles.select(F.col(source).alias("source")).rollup("source").agg(
        F.count(F.lit(1)).alias("articles"), (F.grouping("source") == 1).alias("total")
    )
    return counted.select("source", "articles", "total")
