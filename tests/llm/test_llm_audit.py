import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import odd  # noqa: E402

from broadsheet.llm import audit  # noqa: E402

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs, top=10):
    """``(lang, source, part, item, value, rank)`` by the definition: every pair, every kept term."""
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang in seen:
        terms = [t for t, n in seen[lang].items() if n >= least_docs]
        sources = [s for of, s in counts if of == lang]

        def chances(counter):
            total = sum(counter[t] for t in terms)
            return {t: 1 + 10**9 * (counter[t] + 2) // (total + 2 * len(terms)) for t in terms}

        p = {s: chances(counts[lang, s]) for s in sources}
        q = chances(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            own = [(f(p[s][t], q[t]), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(best)]
    return sorted(out)


def table(spark, rows):
    full = [r + ("clash",) * 6 for r in rows]
    schema = "lang string, source string, text string, term string, value string, at string, p string, rank string, n string"
    return spark.createDataFrame(full, schema).repartition(4)


def random_rows(n=300):
    rng = random.Random(4)
    words = [f"w{'abcdefghij'[i % 10]}{chr(97 + i // 10)}" for i in range(120)] + ["Été", "ÉTÉ", "中文", "x", "don't"]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot"] * 5 + [f"s{i}" for i in range(9)] + [None, ""])
        text = " ".join(rng.choice(words[: rng.choice([5, 30, 125])]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "de", None]), source, text))
    rows += [("xx", "alone", "one source only " * 3)] * 12
    rows += [("en", "empty", None), ("en", "bare", "123 !!"), ("yy", "a", "rare"), ("yy", "b", "words")]
    return rows


@pytest.mark.parametrize("index", [{}, {"entries": 40}, {"text_bytes": 60}])
def test_divergence_equals_brute_force(spark, monkeypatch, index):
    monkeypatch.setattr(audit, "PAGE", 3)
    rows = random_rows()
    found = audit.audit(table(spark, rows), least_docs=10, shards=3, **index)
    assert found.dtypes[4:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10)


def test_divergence_of_odd_rows(spark):
    rows = [(lang, None if i is None else f"src{i % 3}", text) for i, text, lang in odd.ROWS] * 5
    for least in (1, 10):
        found = audit.audit(table(spark, rows), least_docs=least)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, least)
    assert audit.audit(table(spark, [])).count() == 0


def test_chances_of_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 4 * 10**15
    row = spark.range(1).select(audit.chance(F.lit(big), F.lit(3 * big), F.lit(10**9)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 2) // (3 * big + 2 * 10**9)


def test_tiles_are_given_away_when_full():
    rng = np.random.default_rng(2)
    tiles = audit.Tiles(side=4, most=2)
    want, got = Counter(), Counter()
    for _ in range(50):
        at = np.sort(rng.choice(19, rng.integers(1, 12), replace=False))
        value = rng.integers(1, 9, (len(at), len(at)))
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                want[int(at[i]), int(at[j])] += int(value[i, j])
        for _, one, two, v in tiles.add("en", at, lambda i, j: value[i, j]):
            got[one, two] += v
        assert len(tiles.held) <= 2
    for _, one, two, v in tiles.rows():
        got[one, two] += v
    assert got == want


def test_runs_are_merged_by_term(monkeypatch):
    monkeypatch.setattr(audit, "PAGE", 4)
    index = audit.Index(2, entries=40)
    want, batches = Counter(), []
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(f"T{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(5))}" for _ in range(6))
        want.update(text.lower().split())
        index.add(["en"], [rng.choice("abc")], [text.encode()])
        if index.full():
            batches += index.spill()
    batches += index.spill()
    pages = [p for b in batches for p in audit.read_pages(b)]
    assert len(pages) > 100 and all(p.terms[p.at : p.end] == sorted(p.terms[p.at : p.end]) for p in pages)
    pages.sort(key=lambda p: (p.shard, p.lang, p.terms[p.at]))
    rows = list(audit.merged(iter(pages), 1))
    assert {term: sum(counts) for _, term, _, _, counts in rows} == want
    assert len(rows) == len(want)
