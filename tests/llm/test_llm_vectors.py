import math
from collections import Counter

import numpy as np
import pytest

from broadsheet.llm import ann, topk, vectors

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(
        [(i, v, "clash", "clash", "clash") for i, v in rows],
        "vec_id bigint, embedding array<float>, v string, ids string, score string",
    ).repartition(3)


def some(n, width=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[: copies] = x[0]
    return [(int(i), [float(c) for c in r]) for i, r in enumerate(x)]


ODD = [
    (None, [0.5] * 8), (1000, None), (1001, [None] + [0.5] * 7), (1002, [NAN] * 8), (1003, [INF] + [0.0] * 7),
    (1004, []), (1005, [1.0, 2.0]), (1100, [0.0] * 8), (1200, [1e3] * 8), (1200, [1e3] * 8), (1201, [-1e30] + [1.0] * 7),
]


def usable(rows, nonzero):
    return [
        (i, v) for i, v in rows
        if i is not None and v and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v)
        and (any(v) or not nonzero)
    ]


def brute(rows, k, every, score):
    out = {}
    for q, a in rows:
        if q % every == 0:
            best = sorted((-score(a, b), i) for i, b in rows if i != q)[:k]
            out.setdefault(q, Counter()).update((n + 1, i, -s) for n, (s, i) in enumerate(best))
    return out


def whole(a, b):
    f = lambda x: min(math.floor(1024 * float(np.float32(x))), (1 << 63) - 1)
    top = (1 << 63) - 1
    return max(-top, min(top, sum(int(float(f(x))) * int(float(f(y))) for x, y in zip(a, b))))


@pytest.mark.parametrize("copies", [0, 150])
def test_exact_top_k(spark, monkeypatch, copies):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "ROWS", 3)
    rows = some(400, copies=copies)
    found = topk.top_k(table(spark, rows), 10, 20).collect()
    want = brute(rows, 10, 20, whole)
    assert Counter(tuple(r) for r in found) == Counter((q, *e) for q, best in want.items() for e in best)


def test_exact_top_k_of_odd_rows(spark):
    rows = [(i * 50, v) for i, v in some(12)] + [r for r in ODD if r[0] != 1201]
    found = Counter(tuple(r) for r in topk.top_k(table(spark, rows), 30, 100).collect())
    kept = usable(rows, nonzero=False)
    want = brute(list(dict.fromkeys((i, tuple(v)) for i, v in kept)), 30, 100, whole)
    assert {q for q, *_ in found} == set(want)
    single = {q: best for q, best in want.items() if q != 1200}
    for q, best in single.items():
        ids = {i for _, i, _ in best}
        assert {i for r, _, i, _ in found if r == q} == ids
    assert topk.top_k(table(spark, []), 10).count() == 0
    assert topk.top_k(table(spark, [(100, [0.5] * 8)]), 10).count() == 0


def test_scores_that_leave_64_bits_saturate(spark):
    rows = [(0, [1e30] * 8), (1, [1e30] * 8), (2, [-1e30] * 8), (3, [1.0] * 8)]
    found = {r["vec_id"]: r["score"] for r in topk.top_k(table(spark, rows), 10).collect()}
    assert found[1] == (1 << 63) - 1 and found[2] == -((1 << 63) - 1)


@pytest.mark.parametrize("copies", [0, 300])
def test_recall_of_the_tree(spark, monkeypatch, copies):
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    monkeypatch.setattr(ann, "CANDIDATES", 30)
    monkeypatch.setattr(ann, "QUERIES", 9)
    rows = some(1200, copies=copies)
    found = ann.nearest(table(spark, rows), 20, 20).collect()
    exact = lambda a, b: float(np.dot(np.float64(np.float32(a)), np.float64(np.float32(b))))
    want = brute(rows, 20, 20, exact)
    by_id = dict(rows)
    hits = sum(len({i for _, i, _ in want[q]} & {r["vec_id"] for r in found if r["query_id"] == q}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for r in found:
        assert r["score"] == pytest.approx(exact(by_id[r["query_id"]], by_id[r["vec_id"]]), abs=1e-12)
        assert r["query_id"] != r["vec_id"]
    for q in want:
        own = sorted((r["rank"], -r["score"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert [n for n, *_ in own] == list(range(1, len(own) + 1))
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)


def test_tree_on_odd_rows(spark):
    rows = [(i * 10, v) for i, v in some(12)] + ODD
    found = ann.nearest(table(spark, rows), 50, 20).collect()
    kept = {i for i, _ in usable(rows, nonzero=True)}
    assert {r["query_id"] for r in found} == {i for i in kept if i % 20 == 0}
    for q in {r["query_id"] for r in found} - {1200}:
        assert {r["vec_id"] for r in found if r["query_id"] == q} == kept - {q}
    assert ann.nearest(table(spark, []), 20).count() == 0
    assert ann.nearest(table(spark, [(20, [0.5] * 8)]), 20).count() == 0


def test_vectors_meet_those_of_their_own_length(spark):
    long, short = some(60), [(i + 1000, v) for i, v in some(45, width=3, seed=1)]
    rows = long + short + [(2000, [1.0]), (20, short[0][1])]
    parts = [[(i, v) for i, v in rows if len(v) == n] for n in (8, 3, 1)]
    want = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = []
        for part in parts:
            best += [e for at in part if at[0] == q for e in ((-whole(at[1], b), i) for i, b in part if i != q)]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(best)[:10])]
    found = topk.top_k(table(spark, rows), 10, 20).collect()
    assert {tuple(r) for r in found} == {(q, *e) for q, best in want.items() for e in best}
    near = {tuple(r)[:3] for r in ann.nearest(table(spark, rows), 3, 20, wanted=1.0).collect()}
    assert {q for q, *_ in near} == {q for q, best in want.items() if best}
    assert all(i >= 1000 for q, _, i in near if q >= 1000) and all(i < 1000 for q, _, i in near if 20 < q < 1000)


def test_visits_take_the_best_bin_first():
    rows = np.random.default_rng(4).normal(size=(2000, 6))
    tree = ann.Tree.fit(rows, 40)
    leaves = tree.visits(rows[:3], tree.leaves)
    assert all(len(set(v)) == tree.leaves for v in leaves)
    assert set(tree.leaf_of(rows)) <= set(leaves[0])
    first = tree.visits(rows[:3], 5)
    assert [v[:5] for v in leaves] == first


def test_copies_keep_their_smallest_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(99, [2.0, 1.0])]
    kept = vectors.without_copies(vectors.usable(table(spark, rows), "vec_id", "embedding", True), 5).collect()
    assert sorted((r["vec_id"], r["ids"]) for r in kept) == [(0, [0, 1, 2, 3, 4]), (99, [99])]


def test_every_query_has_all_its_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)
    monkeypatch.setattr(ann, "calibrate", lambda *_: 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 10
    rows = [(i, [float(c) for c in np.float32(centres[i % 20] + rng.normal(size=8) * 1e-3)]) for i in range(1200)]
    rows += [(1200 + 20 * i, [float(c) for c in np.float32(rng.normal(size=8) * 1e3)]) for i in range(12)]
    found = ann.nearest(table(spark, rows), 20, 20).collect()
    had = Counter(r["query_id"] for r in found)
    assert had == {i: 20 for i, _ in rows if i % 20 == 0}


def test_visits_go_on_until_the_leaves_hold_enough():
    rows = np.random.default_rng(4).normal(size=(2000, 6))
    tree = ann.Tree.fit(rows, 40)
    held = {leaf: 1 for leaf in tree.visits(rows[:1], tree.leaves)[0][10:]}
    assert [len(v) for v in tree.visits(rows[:1], 2, held, 7)] == [17]
    assert [len(v) for v in tree.visits(rows[:1], 2, held, 10_000)] == [tree.leaves]


def test_repeats_of_an_id_hide_no_other(spark):
    same = [0.5] * 8
    rows = [(100, same)] * 14 + [(101, same), (102, same), (102, same)] + [(200, [-1.0] * 8)]
    # as in the SQL, each of the 14 rows of query 100 finds 101 once
    want = {(100, n, 101) for n in range(1, 11)} | {(200, n, 100) for n in range(1, 11)}
    assert {tuple(r)[:3] for r in topk.top_k(table(spark, rows), 10, 100).collect()} == want
    near = ann.nearest(table(spark, rows), 10, 100).collect()
    assert {tuple(r)[:3] for r in near} == want
