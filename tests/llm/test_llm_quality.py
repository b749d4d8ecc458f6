import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import odd  # noqa: E402

from broadsheet.llm import quality  # noqa: E402


def loss(weights, better, worse, ridge):
    return np.log1p(np.exp(-(better - worse) @ weights)).mean() + ridge / 2 * (weights**2).sum()


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    better, worse, weights = rng.normal(size=(9, 5)), rng.normal(size=(9, 5)), rng.normal(size=5)
    found = quality.pair_gradient(weights, better, worse, 0.1)
    for i in range(5):
        step = np.zeros(5)
        step[i] = 1e-6
        slope = (loss(weights + step, better, worse, 0.1) - loss(weights - step, better, worse, 0.1)) / 2e-6
        assert found[i] == pytest.approx(slope, abs=1e-6)


def test_threshold_is_the_quantile_of_weighted_scores():
    scores = np.array([5.0, 1.0, 3.0, 2.0])
    assert quality.threshold(scores, np.ones(4), 0.5) == 2.5
    assert quality.threshold(scores, np.array([1.0, 6.0, 1.0, 1.0]), 6 / 9) == 1.5


def texts(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 120))]
        good = rng.random() < 0.8
        out.append((i, (" " if good else rng.choice(["%% ", "!! ", " | "])).join(words), int(good)))
    return out


def test_held_out_texts_are_ranked(spark):
    rows = texts(1500)
    docs = odd.table(spark, [(i, t, "en") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = docs.select("doc_id", quality.held_out().alias("held"), quality.score(docs, model).alias("score")).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in scored if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    sure = [r for r in held if len(rows[r["doc_id"]][1]) > 30]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in sure]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = texts(600)
    docs = odd.table(spark, [(i, t, "en") for i, t, _ in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    schema = "doc_id bigint, quality int"
    plain = spark.createDataFrame([(i, y) for i, _, y in rows], schema)
    turned = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], schema)
    one, two = (quality.fit(docs, labels) for labels in (plain, turned))
    assert np.array_equal(one.weights, two.weights) and one.threshold == two.threshold


def test_odd_rows_and_missing_labels(spark):
    table = odd.table(spark)
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    none = quality.fit(table, empty)
    assert {r["s"] for r in table.select(quality.score(table, none).alias("s")).collect()} == {0.0}
    same = spark.createDataFrame([(i, 1) for i in range(5, 12)] + [(None, 0), (1, None)], "doc_id bigint, quality int")
    assert {r["s"] for r in table.select(quality.score(table, quality.fit(table, same)).alias("s")).collect()} == {1.0}
    model = quality.fit_rows(quality.features([t for _, t, _ in texts(200)]), np.array([y for *_, y in texts(200)]), np.ones(200))
    scores = [r["s"] for r in table.select(quality.score(table, model).alias("s")).collect()]
    assert len(scores) == len(odd.ROWS) and all(0 <= s <= 1 for s in scores)
    alone = model.scores([odd.ROWS[6][1]])[0]
    assert model.scores([t for _, t, _ in odd.ROWS])[6] == pytest.approx(alone)
    nothing = odd.table(spark, [])
    assert nothing.select(quality.score(nothing, model).alias("s")).count() == 0
