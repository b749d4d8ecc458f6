"""Word clouds: from texts, from term frequencies, and as a response row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLOUD_FIELDS
from .counts import top_terms, word_counts


def cloud_from_texts(articles: DataFrame, k: int = 100, min_length: int = 2) -> DataFrame:
    """Top words of title and content by the punctuation-stripping tokeniser."""
    return top_terms(word_counts(articles, CLOUD_FIELDS, "stripped", min_length), k)


def counts_from_frequencies(doc_terms: DataFrame, min_length: int = 2) -> DataFrame:
    """Add up term frequencies of title and content over documents."""
    kept = doc_terms.where(
        F.col("field").isin(*CLOUD_FIELDS) & (F.length("term") >= min_length)
    )
    return kept.groupBy("term").agg(F.sum("tf").alias("count"))


def without_stop_words(counts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Remove words from a counter; a stop word that is not there does no harm."""
    return counts.join(stop_words.select("term"), "term", "left_anti")


def cloud_response(counts: DataFrame, k: int = 100) -> DataFrame:
    """One row ``(max_count, result, status, burstcloud)`` with the top words in order.

    Only the ``k`` rows of the ranking are gathered. An empty counter gives a null
    maximum and an empty list.
    """
    entry = F.struct((-F.col("count")).alias("rank"), "term")
    ranked = F.sort_array(F.collect_list(entry))
    result = F.transform(
        ranked, lambda e: F.struct(e["term"].alias("term"), (-e["rank"]).alias("count"))
    )
    return top_terms(counts, k).agg(
        F.max("count").alias("max_count"),
        result.alias("result"),
        F.lit("ok").alias("status"),
        F.lit(False).alias("burstcloud"),
    )
