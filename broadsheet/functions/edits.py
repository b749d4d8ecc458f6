"""Edit distance in characters in which a swap of two neighbours is one edit.

No part of a word is edited twice (optimal string alignment): ``ca`` becomes ``abc`` by three edits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(left: Column, right: Column) -> Column:
    """The distance of two words, by one row of the table of prefixes after the other."""
    size = F.length(right)
    at = lambda word, i: F.substr(word, i, F.lit(1))
    places = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def next_row(rows: Column, i: Column) -> Column:
        last, before = rows["last"], rows["before"]

        def cell(row: Column, j: Column) -> Column:
            same = at(left, i) == at(right, j)
            edits = F.least(
                F.get(last, j) + 1,
                F.get(row, j - 1) + 1,
                F.get(last, j - 1) + F.when(same, 0).otherwise(1),
            )
            swapped = (i > 1) & (j > 1) & (at(left, i) == at(right, j - 1)) & (at(left, i - 1) == at(right, j))
            return F.array_append(row, F.when(swapped, F.least(edits, F.get(before, j - 2) + 1)).otherwise(edits))

        row = F.aggregate(places(size), F.array(i), cell)
        return F.struct(row.alias("last"), last.alias("before"))

    first = F.sequence(F.lit(0), size)
    start = F.struct(first.alias("last"), first.alias("before"))
    return F.aggregate(places(F.length(left)), start, next_row, lambda rows: F.get(rows["last"], size))


def within(left: Column, right: Column, distance: Column) -> Column:
    """Whether two words are within a distance; the whole table is only made where a swap decides."""
    plain = F.call_function("levenshtein", left, right, 2 * distance)  # a swap is two plain edits
    return (
        F.when(F.abs(F.length(left) - F.length(right)) > distance, False)
        .when(plain.between(0, distance), True)
        .when(plain < 0, False)
        .otherwise(edit_distance(left, right) <= distance)
    )


def within_word(word: Column, pattern: str, distance: int) -> Column:
    """``within`` for a fixed pattern: a word that holds none of its swapped pairs needs no table."""
    swapped = {b + a for a, b in zip(pattern, pattern[1:]) if a != b}
    near = F.abs(F.length(word) - len(pattern)) <= distance
    plain = F.levenshtein(word, F.lit(pattern), distance) >= 0
    if not distance or not swapped:
        return near & plain
    spelled = lambda c: c if c.isalnum() else "\\" + c
    held = word.rlike("|".join("".join(map(spelled, pair)) for pair in sorted(swapped)))
    close = F.levenshtein(word, F.lit(pattern), 2 * distance) >= 0  # a swap is two plain edits
    return near & (plain | (close & held & (edit_distance(word, F.lit(pattern)) <= distance)))


def shortened(word: Column, by: int) -> Column:
    """All different texts that are left of a word without ``by`` of its characters."""
    cut = lambda text: F.transform(
        F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1)),
    )
    found = F.array(word)
    for _ in range(by):
        found = F.array_distinct(F.flatten(F.transform(found, cut)))
    return found
