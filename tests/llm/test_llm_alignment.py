import hashlib
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

import odd  # noqa: E402

from broadsheet.llm import alignment  # noqa: E402


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(odd.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=odd.PIECES)


def tokens(libraries, text):
    """``[(id, begin, end)]`` of both sides by the libraries; none where bytes differ."""
    a, b = libraries
    tables = alignment_tables(libraries)
    sides = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, tables[0]), (b.encode(text), tables[1])):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(table(i))))
            at += len(table(i))
        sides.append((side, b"".join(map(table, ids))))
    if not text or any(joined != b" " + text.encode() for _, joined in sides):
        return [], []
    return sides[0][0], sides[1][0]


def alignment_tables(libraries):
    a, b = libraries
    letters = {}
    n = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + n)] = byte
            n += 1

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda i: bytes(letters[c] for c in a.id_to_token(i)), of_b


def brute(libraries, rows):
    """All overlaps of byte ranges by comparison, and counts over all rows."""
    made, counts = [], Counter()
    for i, text in rows:
        a, b = tokens(libraries, text or "")
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for begin, end in zip([0, *cuts], cuts):
            inside = lambda side: ",".join(str(t) for t, s, e in side if begin <= s and e <= end)
            groups.append(f"{inside(a)}|{inside(b)}")
        made.append((i, len(a), len(b), groups, links))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (-1 if i is None else i, n_a, n_b, len(groups), len(links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
             sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
            for i, n_a, n_b, groups, links in made
        )
    )


COLUMNS = "doc_id n_a n_b n_groups n_links groups_sha256 n_best count_sum".split()


def as_rows(found):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in COLUMNS[1:]]) for r in found.collect())


@pytest.fixture
def rows():
    rng = random.Random(6)
    pieces = ["the", "ning", "ß", "über", "中文字", "😀", "don't", "  ", "\n", "\t", "###", "42", "<s>", "<|endoftext|>", "é", "　", "Oneaea", "á"]
    made = [" ".join(rng.choice(pieces) + rng.choice(["", ".", rng.choice(pieces)]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    short = [(i, t if len(t or "") < 5000 else t[:1500]) for i, t, _ in odd.ROWS]
    return short + [(100 + i, t) for i, t in enumerate(made)] + [(500, made[0]), (501, made[0])]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, libraries, monkeypatch, rows, small):
    if small:  # many batches, blocks and lanes
        monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 900)
        monkeypatch.setattr(alignment, "LANE", 40)
    table = odd.table(spark, [(i, t, "en") for i, t in rows])
    found = alignment.align(table, odd.BYTE_BPE, odd.PIECES)
    assert found.columns == COLUMNS
    assert as_rows(found) == brute(libraries, rows)


def test_lists_give_the_links_and_cuts(spark, libraries, rows):
    table = odd.table(spark, [(i, t, "en") for i, t in rows if i is not None and i >= 100])
    found = {r["doc_id"]: r for r in alignment.align(table, odd.BYTE_BPE, odd.PIECES, lists=True).collect()}
    for i, text in rows:
        if i is not None and i >= 100:
            a, b = tokens(libraries, text)
            links = [(x, y) for x, s in enumerate(a) for y, t in enumerate(b) if s[1] < t[2] and t[1] < s[2]]
            assert list(zip(found[i]["links_a"] or [], found[i]["links_b"] or [])) == links
            assert (found[i]["cuts"] or []) == sorted({x[2] for x in a} & {y[2] for y in b})


def test_lanes_change_nothing(monkeypatch):
    made = alignment.Tokenizers(open(odd.BYTE_BPE).read(), open(odd.PIECES, "rb").read())
    texts = [odd.LONG, "short", odd.LONG[:30_000], None, "x" * 9000]
    a, b = made.sides(texts)
    plain = None
    for lane in (1 << 40, 64, 700):
        monkeypatch.setattr(alignment, "LANE", lane)
        found = alignment.lockstep(a, b)
        plain = plain or found
        assert all(np.array_equal(x, y) for x, y in zip(found, plain))
    assert len(alignment.lanes(a, b)[0]) > len(texts) + 2


def test_alignment_of_nothing(spark):
    assert alignment.align(odd.table(spark, []), odd.BYTE_BPE, odd.PIECES).count() == 0
    empty = odd.table(spark, [(1, None, None), (2, "", "en")])
    assert as_rows(alignment.align(empty, odd.BYTE_BPE, odd.PIECES)) == [(i, 0, 0, 0, 0, "", 0, 0) for i in (1, 2)]
