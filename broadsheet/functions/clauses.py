"""Text-match clauses: small immutable trees that become column predicates.

A clause is evaluated over *positioned tokens* (``tokens.analyzed_positions``): lower-cased
words in order, with an empty string where a stop word stood. Build clauses with the
functions below and use them through ``operators.filters.search``, or turn a clause into
rows for the saved-query batch with ``clause_rows``.

    all_of(term("film"), any_of(phrase("greta garbo"), wildcard("bioscoop*")))
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALL, TITLE_ONLY
from .edits import within_word
from .tokens import analyze_query

PerField = dict[str, Column]


@dataclass(frozen=True)
class Leaf:
    """One test: ``kind`` is term, phrase, wildcard or fuzzy.

    A phrase pattern is its words with a blank between them; a stop word inside it is
    empty and stands for any one word.
    """

    kind: str
    pattern: str
    distance: int = 0
    field: str = ALL


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Some:
    parts: tuple


@dataclass(frozen=True)
class Never:
    part: object


@dataclass(frozen=True)
class Nothing:
    """What is left of a clause made of stop words only: ignored next to others."""


Clause = Leaf | Every | Some | Never | Nothing


# --- building ---------------------------------------------------------------------------


def term(text: str) -> Clause:
    """A bare or quoted word. Several words, or a hyphenated one, mean any of them."""
    found = [Leaf("term", w) for w in analyze_query(text) if w]
    return any_of(*dict.fromkeys(found))


def phrase(text: str) -> Clause:
    """Words next to each other in this order. ``*`` and ``?`` only separate words here."""
    places = analyze_query(text)
    while places and not places[0]:
        places = places[1:]
    while places and not places[-1]:
        places = places[:-1]
    if not places:
        return Nothing()
    return Leaf("term" if len(places) == 1 else "phrase", " ".join(places))


def wildcard(pattern: str) -> Clause:
    """``?`` is exactly one character, ``*`` any number; the pattern covers a whole word."""
    pattern = pattern.rstrip("~").lower()
    if not re.search(r"[*?]", pattern):
        return Leaf("term", pattern)
    return Leaf("wildcard", pattern)


def fuzzy(word: str, distance: int | None = None) -> Clause:
    """Words within an edit distance, a swap of neighbours being one edit.

    By default it is 0, 1 or 2 by the length of the word.
    """
    word = word.lower()
    if distance is None:
        distance = 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2
    return Leaf("fuzzy", word, distance) if distance else Leaf("term", word)


def _kept(parts: tuple) -> tuple:
    return tuple(p for p in parts if not isinstance(p, Nothing))


def all_of(*parts: Clause) -> Clause:
    parts = _kept(parts)
    return Nothing() if not parts else parts[0] if len(parts) == 1 else Every(parts)


def any_of(*parts: Clause) -> Clause:
    parts = _kept(parts)
    return Nothing() if not parts else parts[0] if len(parts) == 1 else Some(parts)


def not_(part: Clause) -> Clause:
    return part if isinstance(part, Nothing) else Never(part)


def bool_match(must: list = (), should: list = (), must_not: list = ()) -> Clause:
    """Every ``must``, no ``must_not``; some ``should`` counts only where ``must`` is empty."""
    required = _kept(tuple(must)) or (any_of(*should),)
    return all_of(*required, *[not_(p) for p in must_not])


def in_title(clause: Clause) -> Clause:
    """The same clause over the article title only."""
    match clause:
        case Leaf():
            return Leaf(clause.kind, clause.pattern, clause.distance, TITLE_ONLY)
        case Every(parts):
            return Every(tuple(in_title(p) for p in parts))
        case Some(parts):
            return Some(tuple(in_title(p) for p in parts))
        case Never(part):
            return Never(in_title(part))
    return clause


# --- reading a tree ---------------------------------------------------------------------


def leaves(clause: Clause) -> list[Leaf]:
    match clause:
        case Leaf():
            return [clause]
        case Every(parts) | Some(parts):
            return [leaf for p in parts for leaf in leaves(p)]
        case Never(part):
            return leaves(part)
    return []


def wildcard_regex(pattern: str) -> str:
    """An anchored pattern that Java and RE2 read alike."""
    spelled = {"?": ".", "*": ".*"}
    return "^" + "".join(spelled.get(c, c if c.isalnum() else "\\" + c) for c in pattern) + "$"


def word_test(leaf: Leaf) -> Callable[[Column], Column]:
    """The test of a wildcard or fuzzy leaf on one word."""
    if leaf.kind == "fuzzy":
        return lambda w: (w != "") & within_word(w, leaf.pattern, leaf.distance)
    body = leaf.pattern.strip("*")
    if "*" in body or "?" in body or not body:
        rule = wildcard_regex(leaf.pattern)
        return lambda w: (w != "") & w.rlike(rule)
    starts, ends = not leaf.pattern.startswith("*"), not leaf.pattern.endswith("*")
    if starts:
        return lambda w: w.startswith(body)
    if ends:
        return lambda w: w.endswith(body)
    return lambda w: w.contains(body)


def _leaf_condition(leaf: Leaf, tokens: PerField) -> Column:
    words = tokens[leaf.field]
    if leaf.kind == "term":
        return F.array_contains(words, F.lit(leaf.pattern))
    if leaf.kind == "phrase":
        text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        places = leaf.pattern.split(" ")
        if all(places):
            return text.contains(f" {leaf.pattern} ")
        rule = [re.sub(r"(\W)", r"\\\1", p) if p else "[^ ]*" for p in places]
        return text.rlike(" " + " ".join(rule) + " ")
    return F.exists(words, word_test(leaf))


def condition(clause: Clause, tokens: PerField) -> Column:
    """The clause as a predicate over positioned tokens, one array per field in use."""
    match clause:
        case Leaf():
            return _leaf_condition(clause, tokens)
        case Every(parts):
            return reduce(lambda a, b: a & b, [condition(p, tokens) for p in parts])
        case Some(parts):
            return _some(parts, tokens)
        case Never(part):
            return ~F.coalesce(condition(part, tokens), F.lit(False))
    return F.lit(False)


def _some(parts: tuple, tokens: PerField) -> Column:
    """Terms of one field share a single overlap test; the rest are or-ed."""
    shared: dict[str, list[str]] = {}
    tests = []
    for p in parts:
        if isinstance(p, Leaf) and p.kind == "term":
            shared.setdefault(p.field, []).append(p.pattern)
        else:
            tests.append(condition(p, tokens))
    for field, found in shared.items():
        tests.append(F.arrays_overlap(tokens[field], F.array(*[F.lit(w) for w in found])))
    return reduce(lambda a, b: a | b, tests)


def hint(clause: Clause, lowered: PerField) -> Column | None:
    """A cheap substring test that every match passes, or None if there is none.

    It runs before a text is cut into words, so most texts never are.
    """
    match clause:
        case Leaf(kind=kind, pattern=pattern, field=field):
            runs = [r for r in re.split("[*?]" if kind == "wildcard" else " ", pattern) if r]
            if kind == "fuzzy" or not runs:
                return None
            return reduce(lambda a, b: a & b, [lowered[field].contains(r) for r in runs])
        case Every(parts):
            tests = [t for p in parts if (t := hint(p, lowered)) is not None]
            return reduce(lambda a, b: a & b, tests) if tests else None
        case Some(parts):
            tests = [hint(p, lowered) for p in parts]
            if any(t is None for t in tests):
                return None
            return reduce(lambda a, b: a | b, tests)
    return None


# --- rows for the saved-query batch -----------------------------------------------------


@dataclass(frozen=True)
class ClauseRow:
    """One leaf of a group. ``node`` 0 is the query; other nodes are sub-clauses of it.

    A node holds if one of its alternatives does: every group has a leaf that holds, and no
    leaf of a negated group does. A leaf of kind ``node`` holds if that node (a larger number)
    does.
    """

    node: int
    alt: int
    grp: int
    neg: bool
    leaf: Leaf


_Group = tuple[frozenset[Leaf], bool]


class _Rows:
    """Numbers the sub-clauses that are no plain groups, so nothing is multiplied out."""

    def __init__(self):
        self.rows: list[ClauseRow] = []
        self.nodes: dict[tuple, int] = {}

    def define(self, clause: Clause, wanted: bool) -> int:
        if (clause, wanted) not in self.nodes:
            node = self.nodes[clause, wanted] = len(self.nodes)
            for alt, groups in enumerate(self.alternatives(clause, wanted)):
                for grp, (members, neg) in enumerate(dict.fromkeys(groups)):
                    for leaf in sorted(members, key=repr):
                        self.rows.append(ClauseRow(node, alt, grp, neg, leaf))
        return self.nodes[clause, wanted]

    def alternatives(self, clause: Clause, wanted: bool) -> list[list[_Group]]:
        if _is_all(clause, wanted):
            return [self.groups(clause, wanted)]
        found, plain = [], set()
        for part, want in _flat(clause, wanted):
            if isinstance(part, Leaf) and want:
                plain.add(part)
            else:
                found.append(self.groups(part, want))
        return ([[(frozenset(plain), False)]] if plain else []) + found

    def groups(self, clause: Clause, wanted: bool) -> list[_Group]:
        """Groups that all must hold."""
        if isinstance(clause, Leaf):
            return [(frozenset([clause]), not wanted)]
        if _is_all(clause, wanted):
            return [g for part, want in _flat(clause, wanted) for g in self.groups(part, want)]
        parts = _flat(clause, wanted)
        if all(isinstance(p, Leaf) and want for p, want in parts):
            return [(frozenset(p for p, _ in parts), False)]
        return [(frozenset([Leaf("node", str(self.define(clause, wanted)))]), False)]


def _bare(clause: Clause, wanted: bool) -> tuple[Clause, bool]:
    while isinstance(clause, Never):
        clause, wanted = clause.part, not wanted
    return clause, wanted


def _is_all(clause: Clause, wanted: bool) -> bool:
    clause, wanted = _bare(clause, wanted)
    return not isinstance(clause, Leaf) and isinstance(clause, Every) == wanted


def _flat(clause: Clause, wanted: bool) -> list[tuple[Clause, bool]]:
    """The parts of a clause, with those of the same kind inside it taken up."""
    clause, wanted = _bare(clause, wanted)
    if isinstance(clause, Leaf):
        return [(clause, wanted)]
    out = []
    for part in clause.parts:
        part, want = _bare(part, wanted)
        same = not isinstance(part, Leaf) and _is_all(part, want) == _is_all(clause, wanted)
        out += _flat(part, want) if same else [(part, want)]
    return out


def clause_rows(clause: Clause) -> list[ClauseRow]:
    """The clause as rows, as many as it has leaves; none for a clause that matches nothing."""
    if isinstance(clause, Nothing):
        return []
    made = _Rows()
    made.define(clause, True)
    return made.rows
