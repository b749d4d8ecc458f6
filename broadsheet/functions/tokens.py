"""Three tokenisers as column expressions: raw, stripped and analysed."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that split words, and the blanks between words.
PUNCTUATION = "_|$#<>^=[]*/\\,;.-:()?!\"'"
BLANKS = " \t\n\r\f"

# The Dutch stop words (the Snowball list, as Spark ML ships it).
DUTCH_STOP_WORDS = tuple(
    """
    de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar
    om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar
    haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden
    toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier
    wie werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand
    geweest andere
    """.split()
)

# Word boundaries after Unicode UAX #29: letters joined by a mid-letter mark, digits joined
# by a mid-number mark, and underscores glued to either. Possessive, so that a very long
# run of characters is matched in a loop and not by recursion.
_MID_LETTER = "['’‘.:·]"
_MID_NUMBER = "['’‘.,;]"
WORD_PATTERN = (
    rf"(?:[\p{{L}}\p{{M}}]++(?:{_MID_LETTER}[\p{{L}}\p{{M}}]++)*+"
    rf"|\p{{N}}++(?:{_MID_NUMBER}\p{{N}}++)*+"
    r"|_++)++"
)
# The same for the few words of a query, which are analysed where the query is written. Python's
# patterns know no marks, so letters and marks are written as ``a`` and numbers as ``0`` first.
_QUERY_WORD = re.compile(rf"(?:a+(?:{_MID_LETTER}a+)*|0+(?:{_MID_NUMBER}0+)*|_+)+")
_KINDS = {"L": "a", "M": "a", "N": "0"}


def joined(*columns: Column | str) -> Column:
    """Several fields as one text; the blank between them always ends a word."""
    return F.concat_ws(" ", *columns)


def raw_pieces(text: Column) -> Column:
    """Text cut at blanks, case and punctuation kept; may hold empty pieces."""
    return F.split(text, f"[{BLANKS}]+")


def raw_tokens(text: Column) -> Column:
    return F.filter(raw_pieces(text), lambda w: w != "")


def stripped_pieces(text: Column) -> Column:
    """Lower-cased text cut at blanks and punctuation; may hold empty pieces."""
    marks = "".join("\\" + mark for mark in PUNCTUATION)
    return F.split(F.lower(text), f"[{marks}{BLANKS}]+")


def stripped_tokens(text: Column, min_length: int = 1) -> Column:
    return F.filter(stripped_pieces(text), lambda w: F.length(w) >= max(min_length, 1))


def pieces_of(lowered: Column) -> Column:
    """Words of a lower-cased text before the checks ``is_word`` and ``is_stop_word``."""
    return F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0))


def is_word(word: Column) -> Column:
    return ~word.startswith("_") | (F.translate(word, "_", "") != "")


def is_stop_word(word: Column) -> Column:
    return word.isin(*DUTCH_STOP_WORDS)


def analyzed_pieces(text: Column) -> Column:
    """As ``pieces_of``, for use with ``explode``."""
    return pieces_of(F.lower(text))


def analyzed_tokens(text: Column) -> Column:
    """Words without stop words; repeats are kept."""
    return F.filter(analyzed_pieces(text), lambda w: is_word(w) & ~is_stop_word(w))


def analyzed_positions(text: Column) -> Column:
    """Words with their places kept: a stop word leaves an empty string behind."""
    return positions_of(F.lower(text))


def positions_of(lowered: Column) -> Column:
    words = F.filter(pieces_of(lowered), is_word)
    return F.transform(words, lambda w: F.when(is_stop_word(w), "").otherwise(w))


def analyze_query(text: str) -> list[str]:
    """The words of a query text; a stop word leaves an empty string, as above."""
    lower = text.lower()
    other = lambda c: c if c in "'’‘.:·,;_" else " "
    kinds = "".join(_KINDS.get(unicodedata.category(c)[0], other(c)) for c in lower)
    found = [lower[m.start() : m.end()] for m in _QUERY_WORD.finditer(kinds)]
    found = [w for w in found if w.strip("_")]
    return ["" if w in DUTCH_STOP_WORDS else w for w in found]
