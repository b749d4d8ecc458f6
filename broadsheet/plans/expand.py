"""Wildcard and fuzzy patterns to the words of a vocabulary.

Patterns without a letter match by length alone (``expand_lengths``). Others meet words through
equi joins only. A wildcard has an *anchor*, a piece of text that every matching word holds at its
start, at its end or anywhere. A fuzzy pattern and a word within its distance have a common text
after each has lost that many characters at most (swaps included), so they meet on
what is left of them. Words are exploded into their own pieces of the places and lengths in use, joined on
the piece, and the pairs are then verified. Every step is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import shortened, within

_NEAR = "near:"
#: Wildcards meet words on pieces of these lengths only: a longer literal is met on a part of it. So a
#: word has a fixed number of pieces a character, however many lengths the patterns have.
_PIECES = (8, 5, 3, 2, 1)
_KEYS = "array<struct<at:string,piece:string>>"


def _anchor(at: str, piece: Column) -> Column:
    return F.struct(F.lit(at).alias("at"), piece.alias("piece"))


def _wildcard_anchors(pattern: Column) -> Column:
    """A piece of the longest literal run, with the place where it must be in the word. There is one."""
    runs = F.filter(F.split(pattern, "[*?]+"), lambda r: r != "")
    longest = F.aggregate(
        runs, F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a)
    )
    size = F.coalesce(*[F.when(F.length(longest) >= n, F.lit(n)) for n in _PIECES])
    anchor = (
        F.when(pattern.startswith(longest), _anchor("start", F.left(longest, size)))
        .when(pattern.endswith(longest), _anchor("end", F.right(longest, size)))
        .otherwise(_anchor("inside", F.left(longest, size)))
    )
    return F.array(anchor)


def _fuzzy_anchors(word: Column, distance: int) -> Column:
    """What is left of the pattern without up to ``distance`` characters.

    The place names the distance and the length of the words to meet, which says how many
    characters these lose.
    """
    keys = []
    for lost in range(distance + 1):
        left = F.length(word) - lost
        lengths = F.sequence(left, left + distance)
        pieces = shortened(word, lost)
        place = lambda n: F.concat(F.lit(f"{_NEAR}{distance}:"), n.cast("string"))
        met = F.flatten(
            F.transform(
                lengths, lambda n: F.transform(pieces, lambda p: F.struct(place(n).alias("at"), p.alias("piece")))
            )
        )
        keys.append(F.when(left >= 0, met).otherwise(F.array().cast(_KEYS)))
    return F.concat(*keys)


def pattern_anchors(patterns: DataFrame, distances: list[int]) -> DataFrame:
    """Patterns ``(kind, pattern, distance)`` with one row for each anchor.

    ``distances`` are those of the fuzzy ones.
    """
    anchors = F.when(F.col("kind") != "fuzzy", _wildcard_anchors(F.col("pattern")).cast(_KEYS))
    for distance in distances:
        anchors = anchors.when(F.col("distance") == distance, _fuzzy_anchors(F.col("pattern"), distance).cast(_KEYS))
    return patterns.select("kind", "pattern", "distance", F.inline(anchors))


def _pieces(word: Column, used: list[tuple[str, int]]) -> Column:
    """The pieces of a word for the places and lengths in use."""
    length = F.length(word)
    none = F.array().cast(_KEYS)
    near: dict[tuple[str, int], list[int]] = {}
    tests = []
    for at, n in used:
        if at.startswith(_NEAR):
            distance, size = at.removeprefix(_NEAR).split(":")
            near.setdefault((distance, int(size) - n), []).append(int(size))
        else:
            tests.append((length >= n, _pieces_at(word, at, n)))
    for (distance, lost), sizes in near.items():
        tests.append((length.isin(*sizes), _near_pieces(word, distance, lost)))
    return F.concat(*[F.when(test, keys).otherwise(none) for test, keys in tests])


def _near_pieces(word: Column, distance: str, lost: int) -> Column:
    at = F.concat(F.lit(f"{_NEAR}{distance}:"), F.length(word).cast("string"))
    return F.transform(shortened(word, lost), lambda p: F.struct(at.alias("at"), p.alias("piece")))


def _substrings(word: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(word, i, F.lit(n)))


def _pieces_at(word: Column, at: str, n: int) -> Column:
    if at == "inside":
        return F.transform(_substrings(word, n), lambda piece: _anchor(at, piece))
    size = F.lit(n)
    piece = {"start": F.left(word, size), "end": F.right(word, size)}
    return F.array(_anchor(at, piece[at]))


def _matches() -> Column:
    word, pattern, distance = F.col("term"), F.col("pattern"), F.col("distance")
    literal = F.regexp_replace(pattern, r"([^\p{L}\p{N}*?])", r"\\$1")
    rule = F.concat(
        F.lit("^"), F.replace(F.replace(literal, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*")), F.lit("$")
    )
    return F.when(F.col("kind") == "fuzzy", within(word, pattern, distance)).otherwise(F.rlike(word, rule))


def expand_lengths(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(kind, pattern, distance, key)``: the lengths of words that patterns without letters match.

    Such a pattern only counts characters. It becomes a key for each length, never for each word.
    """
    own = patterns.select("kind", "pattern", "distance").distinct()
    counted = own.withColumn("least", F.length(F.replace("pattern", F.lit("*"), F.lit(""))))
    longest = vocabulary.agg(F.max(F.length("term"))).first()[0] or 0
    open_ = F.contains(F.col("pattern"), F.lit("*"))
    upto = F.when(open_, F.greatest(F.lit(longest), F.col("least"))).otherwise(F.col("least"))
    return counted.select(
        "kind", "pattern", "distance", F.explode(F.sequence("least", upto)).alias("key")
    ).withColumn("key", F.col("key").cast("string"))


def expand(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(kind, pattern, distance, term)`` for each word that a pattern with letters matches."""
    own = patterns.select("kind", "pattern", "distance").distinct()
    # What users type: a few distances.
    near = sorted(r[0] for r in own.where(F.col("kind") == "fuzzy").select("distance").distinct().collect())
    anchors = pattern_anchors(own, near)
    lengths = anchors.select("at", F.length("piece").alias("n")).distinct()
    # One entry for each place and length of a piece: few of wildcards, of fuzzy ones bounded by
    # the length of a pattern.
    used = sorted((r["at"], r["n"]) for r in lengths.collect())
    words = vocabulary.where(F.col("term") != "")
    if not used:
        return words.join(anchors, F.lit(False), "inner").select("kind", "pattern", "distance", "term")
    pieces = words.select("term", F.inline(_pieces(F.col("term"), used)))
    pairs = pieces.join(anchors, ["at", "piece"]).where(_matches())
    return pairs.select("kind", "pattern", "distance", "term").distinct()
