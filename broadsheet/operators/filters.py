"""Filters over articles: dates, exclusions, text clauses and the size gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clauses import Clause, condition, hint, leaves
from ..functions.once import once
from ..functions.tokens import joined, positions_of
from ..schema import (
    ARTICLE_TYPE_LABELS,
    DATE,
    DISTRIBUTION_LABELS,
    SEARCH_TEXT,
    SPATIAL,
    STORED_WORDS,
    SUBJECT,
    labels_for,
)


def date_between(lower, upper, column: str = DATE) -> Column:
    """Both ends belong to the range."""
    return F.col(column).between(F.lit(lower).cast("date"), F.lit(upper).cast("date"))


def label_not_in(column: str, labels: Sequence[str]) -> Column:
    """Exact match on a label; an article without a label is kept. The scan can test this."""
    if not labels:
        return F.lit(True)
    return F.col(column).isNull() | ~F.col(column).isin(*labels)


def not_excluded(
    exclude_distributions: Sequence[str] = (), exclude_article_types: Sequence[str] = ()
) -> Column:
    """Neither an excluded distribution nor an excluded article type, given as codes."""
    return label_not_in(
        SPATIAL, labels_for(list(exclude_distributions), DISTRIBUTION_LABELS)
    ) & label_not_in(SUBJECT, labels_for(list(exclude_article_types), ARTICLE_TYPE_LABELS))


def search(articles: DataFrame, clause: Clause) -> DataFrame:
    """Articles that match a text clause.

    Texts that cannot match are dropped by a substring test; the others are cut into words.
    Both the lower-cased text and the words are made once, whatever the number of leaves:
    one-row generators hold them, because a filter over a plain projection would repeat
    the work for every leaf. A corpus that stores its words (``with_words``) needs neither.
    """
    used = sorted({leaf.field for leaf in leaves(clause)})
    if not used:
        return articles.where(F.lit(False))
    stored = {f: F.col(STORED_WORDS[f]) for f in used if STORED_WORDS[f] in articles.columns}
    if len(stored) == len(used):
        return articles.where(condition(clause, stored))
    lowered = {f: F.lower(joined(*SEARCH_TEXT[f])) for f in used}
    found = once(articles, {f"_{f}_text": c for f, c in lowered.items()})
    text = {f: F.col(f"_{f}_text") for f in used}
    maybe = hint(clause, text)
    if maybe is not None:
        found = found.where(maybe)
    found = once(found, {f"_{f}_words": positions_of(c) for f, c in text.items()})
    words = {f: F.col(f"_{f}_words") for f in used}
    return found.where(condition(clause, words)).select(*articles.columns)


def with_words(articles: DataFrame) -> DataFrame:
    """Articles with their positioned words as columns, to be stored once and searched often."""
    words = {STORED_WORDS[f]: positions_of(F.lower(joined(*t))) for f, t in SEARCH_TEXT.items()}
    return articles.withColumns(words)


def filtered_query(
    articles: DataFrame,
    clause: Clause,
    date_lower,
    date_upper,
    exclude_distributions: Sequence[str] = (),
    exclude_article_types: Sequence[str] = (),
) -> DataFrame:
    """Text clause AND date range AND NOT excluded; the cheap tests reach the scan."""
    kept = articles.where(
        date_between(date_lower, date_upper)
        & not_excluded(exclude_distributions, exclude_article_types)
    )
    return search(kept, clause)


def size_status(count: Column, smallest: int = 10_000, largest: int = 50_000) -> Column:
    """``ok`` inside the bounds, else why a query is skipped."""
    return (
        F.when((count <= 0) | (count < smallest), "too_few")
        .when(count > largest, "too_many")
        .otherwise("ok")
    )


def size_gate(counts: DataFrame, smallest: int = 10_000, largest: int = 50_000) -> DataFrame:
    return counts.withColumn("status", size_status(F.col("count"), smallest, largest))
