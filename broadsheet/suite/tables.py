"""Saved queries and clauses derived from the ``benchmark`` table.

Each passage becomes one saved query, so the batch grows with the table. The kind of the
clauses follows from the key and covers every form of match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import analyzed_positions, analyzed_tokens

# Exclusion lists as a saved query stores them, chosen by the key.
TYPE_LISTS = ("", "st_advert", "st_advert+st_illust+st_family", "st_family+st_illust")
DISTRIBUTION_LISTS = ("", "sd_antilles+sd_indonesia+sd_surinam", "sd_regional")


def _choose(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def picked_words(text: Column) -> Column:
    """Four words of the whole passage: of its distinct words, longest first, the first one, the
    middle one, the last one and the one after a quarter."""
    by_length = F.array_sort(
        F.transform(
            F.array_distinct(analyzed_tokens(text)),
            lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")),
        )
    )["w"]
    last = F.size(by_length) - 1
    places = [F.lit(0), F.floor(last / 2), last, F.floor(last / 4)]
    return F.array(*[F.get(by_length, at.cast("int")) for at in places])


def middle_places(text: Column) -> Column:
    """Three places in the middle of a passage, as a phrase holds them."""
    places = analyzed_positions(text)
    start = F.greatest(F.floor((F.size(places) - 3) / 2).cast("int"), F.lit(0)) + 1
    return F.trim(F.array_join(F.slice(places, start, F.lit(3)), " "))


def stored_queries(benchmark: DataFrame) -> DataFrame:
    """A saved-query table in its stored form: numbers as reals, dates and lists as text."""
    key = F.col("item_id")
    words = picked_words(F.col("text"))
    return benchmark.select(
        key.cast("double").alias("id"),
        F.array_join(F.slice(words, 1, 3), " ").alias("query"),
        F.concat((key % 40 + 1850).cast("string"), F.lit("-01-01")).alias("date_lower"),
        F.concat((key % 70 + 1920).cast("string"), F.lit("-12-31")).alias("date_upper"),
        _choose(key, TYPE_LISTS).alias("exclude_article_type"),
        _choose(key, DISTRIBUTION_LISTS).alias("exclude_distributions"),
        (key % 6).cast("double").alias("user_id"),
    )


def stored_clauses(benchmark: DataFrame) -> DataFrame:
    """The clause table of ``stored_queries``."""
    key = F.col("item_id")
    base = benchmark.select(
        key.cast("int").alias("query_id"),
        (key % 6).alias("form"),
        picked_words(F.col("text")).alias("w"),
        middle_places(F.col("text")).alias("p"),
    )
    w = lambda n: F.get("w", F.lit(n - 1))
    row = lambda form, alt, grp, neg, field, kind, pattern, distance: F.struct(
        F.lit(form).alias("of"),
        F.lit(alt).alias("alt"),
        F.lit(grp).alias("grp"),
        F.lit(neg).alias("neg"),
        F.lit(field).alias("field"),
        F.lit(kind).alias("kind"),
        pattern.alias("pattern"),
        F.lit(distance).alias("distance"),
    )
    question = F.concat(F.left(w(2), F.lit(1)), F.lit("?"), F.substr(w(2), F.lit(3)))
    forms = F.array(
        # any of three words
        row(0, 0, 0, False, "all", "term", w(1), 0),
        row(0, 0, 0, False, "all", "term", w(2), 0),
        row(0, 0, 0, False, "all", "term", w(3), 0),
        # two words, both required
        row(1, 0, 0, False, "all", "term", w(1), 0),
        row(1, 0, 1, False, "all", "term", w(2), 0),
        # one word without another
        row(2, 0, 0, False, "all", "term", w(1), 0),
        row(2, 0, 1, True, "all", "term", w(4), 0),
        # a phrase of three places
        row(3, 0, 0, False, "all", "phrase", F.col("p"), 0),
        # two wildcards, either will do
        row(4, 0, 0, False, "all", "wildcard", F.concat(F.left(w(1), F.lit(4)), F.lit("*")), 0),
        row(4, 0, 0, False, "all", "wildcard", question, 0),
        # a near word, or else a word in the title
        row(5, 0, 0, False, "all", "fuzzy", w(1), 1),
        row(5, 1, 0, False, "title", "term", w(2), 0),
    )
    rows = base.select("query_id", "form", F.inline(forms))
    return rows.where((F.col("of") == F.col("form")) & (F.col("pattern") != "")).drop("of", "form")


def pattern_clauses(benchmark: DataFrame) -> DataFrame:
    """One pattern a passage: any word, five characters, a short word with edits, an inner piece."""
    key, w = F.col("item_id"), picked_words(F.col("text"))
    inner = F.concat(F.lit("*"), F.substr(F.get(w, F.lit(0)), F.lit(2), F.lit(3)), F.lit("*"))
    short = F.left(F.get(w, F.lit(1)), F.lit(2))
    patterns = [("wildcard", F.lit("*"), 0), ("wildcard", F.lit("?????"), 0), ("fuzzy", short, 2), ("wildcard", inner, 0)]
    made = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), text.alias("pattern"), F.lit(n).alias("distance"))
            for kind, text, n in patterns
        ]
    )
    chosen = benchmark.select(key, F.get(made, (key % 4).cast("int")).alias("leaf"))
    return chosen.select(
        key.cast("int").alias("query_id"), F.lit(0).alias("alt"), F.lit(0).alias("grp"),
        F.lit(False).alias("neg"), F.lit("all").alias("field"), "leaf.*",
    )
