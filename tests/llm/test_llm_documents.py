import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import odd  # noqa: E402

from broadsheet.llm import common, components, language, lines, shards, simhash, toxicity  # noqa: E402


# --- shared lines -----------------------------------------------------------------------


def key_of(line):
    bare = line.strip(" \t\n\v\f\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), bare)


def brute_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    none = -(1 << 63)
    for i, text in rows:
        for line in text.split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(none if i is None else i)
    shared = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = Counter()
    for i, text in rows:
        cut = text.split("\n")
        kept = [x for x in cut if shared.get(key_of(x), i) == i or len(key_of(x)) < min_chars]
        out[i, len(cut), len(cut) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_shared_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    found = lines.drop_shared_lines(odd.table(spark)).select("doc.doc_id", "n_lines", "n_dropped", "kept", "doc.lines")
    rows = found.collect()
    assert Counter(tuple(r)[:4] for r in rows) == brute_lines(odd.texts())
    assert {r["lines"] for r in rows} == {"clash"}
    assert lines.drop_shared_lines(odd.table(spark, [])).count() == 0


def test_no_python_in_line_dedup(spark, plan_of):
    plan = plan_of(lines.drop_shared_lines(odd.table(spark)))
    assert not re.search("Python|Pandas|Arrow", plan)


# --- shards -----------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(spark):
    rows = [(i, "y" * (i * 37 % 900), "en") for i in range(3000)] + [(9000 + i, "copy " * 20, "en") for i in range(1500)]
    found = shards.shard(odd.table(spark, rows), 24).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, _ in rows
    )
    total = Counter()
    for r in found:
        total[r["shard"]] += r["size"]
    assert sorted(total) == list(range(24))
    mean = sum(total.values()) / 24
    assert max(abs(n - mean) for n in total.values()) <= 2 * (908 + shards.SLACK * mean)
    for n in range(24):
        assert sorted(r["slot"] for r in found if r["shard"] == n) == list(range(sum(r["shard"] == n for r in found)))


def test_small_groups_of_copies_stay_together(spark):
    rows = [(i, f"text {i // 3} " + "z" * 50, "en") for i in range(60_00)]
    found = shards.shard(odd.table(spark, rows), 5).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    assert found.where("n > 1").count() == 0


@pytest.mark.parametrize("slack", [0.0, 0.3, 1.0])
def test_slack_keeps_groups_whole_and_bounds_the_balance(spark, slack):
    sizes = [1] * 400 + [300, 150, 40, 2000]  # copies of each text; the last group is over a shard
    rows = [(n * 10_000 + i, f"text {n} " + "z" * 50, "en") for n, of in enumerate(sizes) for i in range(of)]
    found = shards.shard(odd.table(spark, rows), 5, slack=slack).collect()
    total, places, bytes_of = Counter(), defaultdict(set), Counter()
    for r in found:
        total[r["shard"]] += r["size"]
        places[r["text_crc32"]].add(r["shard"])
        bytes_of[r["text_crc32"]] += r["size"]
    mean = sum(total.values()) / 5
    assert all(len(places[t]) == 1 for t, n in bytes_of.items() if n <= slack * mean)
    assert max(abs(total[n] - mean) for n in range(5)) <= max(80, slack * mean)


def test_shards_of_odd_rows(spark):
    found = shards.shard(odd.table(spark), 4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(t.encode()) + 8) for i, t in odd.texts())
    assert {r["shard"] for r in found} <= set(range(4))
    assert shards.shard(odd.table(spark, []), 4).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    shards.write_shards(odd.table(spark), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.select("doc_id", "text").collect()) == Counter(
        (i, t) for i, t, _ in odd.ROWS
    )


# --- language ---------------------------------------------------------------------------


def test_language_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    found = docs.select("doc_id", "lang", language.held_out().alias("out"), language.predicted(docs, model).alias("p"))
    rows = found.where("out").collect()
    assert len(rows) > 100
    assert sum(r["p"]["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))
    changed = docs.withColumn("lang", lang)
    a, b = language.fit(docs), language.fit(changed)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_language_of_odd_rows(spark):
    docs = odd.table(spark)
    rows = docs.select("doc_id", "text", language.predicted(docs, language.fit(docs)).alias("p")).collect()
    assert len(rows) == len(odd.ROWS)
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang_pred"] != "und") == has_letter
        assert 0 <= r["p"]["score"] <= 1
    empty = odd.table(spark, [])
    model = language.fit(empty)
    assert empty.select(language.predicted(empty, model)).count() == 0
    assert {r["p"]["lang_pred"] for r in docs.select(language.predicted(docs, model).alias("p")).collect()} == {"und"}


def test_folded_weights_are_the_kernel_machine():
    rng = np.random.default_rng(0)
    bits = rng.random((60, language.BUCKETS)) < 0.02
    labels = ["a", "b", "c"] * 20
    model = language.fit_rows(np.packbits(bits, axis=1), labels, landmarks=60, ridge=1e-2)
    kernel = (bits.astype(float) @ bits.T) / np.sqrt(np.outer(bits.sum(1), bits.sum(1)))
    target = np.where(np.array(labels)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    middle = kernel.mean(0)
    centred = kernel - middle - (kernel - middle).mean(1, keepdims=True)
    level = target.mean(0)
    want = level + centred @ np.linalg.solve(centred + 1e-2 * 60 * np.eye(60), target - level)
    assert np.abs(model.scores(bits.astype(np.float32)) - want).max() < 0.02
    assert language.fit_rows(np.packbits(bits[:3], axis=1), ["a"] * 3).predict(["some text"])[0] == ["a"]


def test_presence_does_not_depend_on_the_cut(monkeypatch):
    text = "Ein langer Satz, der mehrmals 12 geteilt wird. " * 30
    whole = language.presence(text)
    monkeypatch.setattr(language, "CHUNK", 64)
    assert (language.presence(text) == whole).all()
    text = "ab" + " " * 200 + "c d" + "1" * 63 + "e" + "-" * 64 + "fg"  # runs of blanks over whole chunks
    cut = language.presence(text)
    monkeypatch.undo()
    assert (cut == language.presence(text)).all()
    assert language.presence("12 !") is None


# --- toxicity ---------------------------------------------------------------------------


def test_toxicity_needs_the_pair():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(3000):
        words = set(rng.choice(200, 12).tolist())
        words |= {1000} if rng.random() < 0.4 else set()
        words |= {2000} if rng.random() < 0.4 else set()
        rows.append(np.array(sorted(words)))
        labels.append(float({1000, 2000} <= words))
    model = toxicity.fit_rows(rows[:2000], np.array(labels[:2000]), np.ones(2000))
    known = [[model.known[w] for w in r.tolist() if w in model.known] for r in rows[2000:]]
    assert np.mean((model.logits(known) > 0) == np.array(labels[2000:])) > 0.98


def test_toxicity_needs_a_pair_of_terms_that_tell_nothing_alone():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for n in range(4000):
        words = set(rng.choice(200, 12).tolist())
        first, second = n % 2 < 1, n % 4 < 2  # each in half of the texts of either label
        words |= ({1000} if first else set()) | ({2000} if second else set())
        rows.append(np.array(sorted(words)))
        labels.append(float(first == second))
    model = toxicity.fit_rows(rows[:3000], np.array(labels[:3000]), np.ones(3000))
    assert {1000, 2000} <= set(model.known)
    known = [[model.known[w] for w in r.tolist() if w in model.known] for r in rows[3000:]]
    assert np.mean((model.logits(known) > 0) == np.array(labels[3000:])) > 0.98


def test_toxicity_learns_a_rare_insult():
    rng = np.random.default_rng(6)
    rows = [np.array(sorted(set(rng.choice(200, 12).tolist()) | ({3000} if n < 12 else set()))) for n in range(4000)]
    model = toxicity.fit_rows(rows, (np.arange(4000) < 2000).astype(float), np.ones(4000))
    weights = model.weights[[model.known[w] for w in range(200)]]
    assert model.weights[model.known[3000]] > max(0.3, np.abs(weights).max())


def test_logits_are_sums_over_all_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.Model(np.arange(30), rng.normal(size=30), rng.normal(size=(30, 8)), -0.5)
    rows = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 1, 2, 9)]
    for row, found in zip(rows, model.logits(rows)):
        pairs = sum(model.factors[i] @ model.factors[j] for i in row for j in row if i < j)
        assert found == pytest.approx(-0.5 + model.weights[row].sum() + pairs)


def test_gradient_of_the_machine_against_differences():
    rng = np.random.default_rng(4)
    sizes, labels, shares = np.array([3, 0, 4]), np.array([1.0, 0.0, 0.0]), np.array([0.5, 1.0, 2.0])
    cols = np.array([0, 2, 4, 1, 2, 3, 4])
    w, v = rng.normal(size=5), rng.normal(size=(5, 8))

    def loss(w, v, b):
        rows = [cols[:3].tolist(), [], cols[3:].tolist()]
        x = toxicity.Model(np.arange(5), w, v, b).logits(rows)
        return (shares * (np.log1p(np.exp(x)) - labels * x)).mean()

    own, pair, shift = toxicity.gradient(w, v, 0.1, cols, sizes, labels, shares)
    near = lambda a, b: (a - b) / 2e-4
    assert shift == pytest.approx(near(loss(w, v, 0.1001), loss(w, v, 0.0999)), abs=1e-3)
    for i in range(5):
        step = np.eye(5)[i] * 1e-4
        assert own[i] == pytest.approx(near(loss(w + step, v, 0.1), loss(w - step, v, 0.1)), abs=1e-3)
        for f in range(8):
            step = np.zeros((5, 8))
            step[i, f] = 1e-4
            assert pair[i, f] == pytest.approx(near(loss(w, v + step, 0.1), loss(w, v - step, 0.1)), abs=1e-3)


def test_the_driver_gets_a_bounded_number_of_terms(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)) + (" bad" if i % 2 else " good"), "en") for i in range(400)]
    docs = odd.table(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    got = []
    monkeypatch.setattr(toxicity, "fit_rows", lambda *a: got.append(a))
    toxicity.fit(docs, labels, sample_terms=4000)
    sample, y, weights = got[0]
    for label in (0, 1):
        assert 1500 < sum(len(r) for r, of in zip(sample, y) if of == label) <= 2000
        assert weights[y == label].sum() == pytest.approx(160, rel=0.4)


def test_toxicity_of_the_test_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    marked = labels.select("doc_id", "toxic").where(language.held_out())
    rows = docs.join(marked, "doc_id").select("toxic", toxicity.score(docs, model).alias("s")).collect()
    said = [r for r in rows if r["s"] >= 0.5]
    hit = sum(r["toxic"] for r in said)
    assert hit >= 0.95 * len(said) and hit >= 0.8 * sum(r["toxic"] for r in rows)


def test_toxicity_of_odd_rows(spark):
    docs = odd.table(spark)
    labels = spark.createDataFrame(
        [(1, 0), (2, 1), (2, 0), (6, 1), (8, 0), (None, 1), (9, None)], "doc_id bigint, toxic int"
    )
    model = toxicity.fit(docs, labels)
    scores = [r[0] for r in docs.select(toxicity.score(docs, model)).collect()]
    assert len(scores) == len(odd.ROWS) and all(0 <= s <= 1 for s in scores)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r[0] < 0.5 for r in docs.select(toxicity.score(docs, none)).collect()} == {True}
    empty = odd.table(spark, [])
    assert empty.select(toxicity.score(empty, toxicity.fit(empty, labels))).count() == 0


# --- near duplicates --------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", key_of(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """For each (id, fingerprint) the smallest id reached over near fingerprints and equal ids."""
    group = list(range(len(prints)))
    for a, (i, p) in enumerate(prints):
        for b, (j, q) in enumerate(prints[:a]):
            if (p ^ q).bit_count() <= 2 or (i is not None and i == j):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((i for (i, _), h in zip(prints, group) if h == g and i is not None), default=None) for g in set(group)}
    return [least[g] for g in group]


def test_a_repeated_id_is_one_document(spark, monkeypatch):
    a, b, c = "one text of its own", "quite another thing here", "and a third one besides"
    rows = [(3, a, "en"), (12, a, "en"), (12, b, "en"), (12, b, "en"), (20, b, "en"), (30, c, "en"), (30, c, "en")]
    prints = [(i, brute_simhash(t)) for i, t, _ in rows]
    for hot in (1, 1000):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        found = simhash.near_duplicates(odd.table(spark, rows)).collect()
        got = Counter((r["doc_id"], r["component_id"]) for r in found)
        assert got == Counter((i, g) for (i, _), g in zip(prints, brute_components(prints)))
        assert got == {(3, 3): 1, (12, 3): 3, (20, 3): 1, (30, 30): 2}


def test_simhash_of_odd_rows(spark):
    found = simhash.near_duplicates(odd.table(spark)).withColumn("hex", simhash.hexadecimal(F.col("fingerprint")))
    rows = found.collect()
    prints = [(i, brute_simhash(t)) for i, t in odd.texts()]
    assert Counter((r["doc_id"], r["hex"]) for r in rows) == Counter((i, f"{p:016x}") for i, p in prints)
    want = Counter((i, c) for (i, _), c in zip(prints, brute_components(prints)))
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(odd.table(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    for _ in range(60):
        n = int(rng.integers(1, 300))
        groups = np.sort(rng.integers(0, rng.integers(1, 6), n))
        prints = rng.integers(0, 1 << int(rng.integers(3, 17)), n).astype(np.uint16)
        left, right = simhash.near(prints, groups, radius)
        close = np.bitwise_count(prints[:, None] ^ prints) <= radius
        i, j = np.nonzero(np.triu(close & (groups[:, None] == groups), 1))
        assert set(zip(left.tolist(), right.tolist())) == set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("radius", [1, 2])
def test_links_are_all_found(spark, radius):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40)
    flips = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for b in base for _ in range(6)]
    prints = sorted({(p ^ (1 << 64)) & ((1 << 64) - 1) for p in flips})
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint bigint, id bigint"), radius)
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    root = list(range(len(prints)))
    for _ in range(8):
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: found.get(i, i) for i in range(len(prints))} == dict(enumerate(root))


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i + 1, i) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame(path + star + [(7, 7), (3, 2)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(edges.limit(0)).count() == 0


# --- lookups with hot keys --------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    left = spark.range(90).selectExpr("id", "case when id < 60 then 0 when id < 80 then id else null end as k")
    right = left.where("k is not null and k < 70").groupBy("k").count().selectExpr("k", "count as rows", "k * 2 as v")
    found = common.lookup(left, right, ["k"], "rows", 90, how)
    assert sorted(map(str, found.collect())) == sorted(map(str, left.join(right.drop("rows"), ["k"], how).collect()))


def test_sha_of_an_empty_text_is_that_of_nothing(spark):
    kept = lines.drop_shared_lines(odd.table(spark, [(1, None, None)])).select(F.sha2("kept", 256)).first()[0]
    assert kept == hashlib.sha256(b"").hexdigest()


def test_rows_with_null_ids_have_their_group(spark, monkeypatch):
    rows = [(5, "0", None), (None, "3", None), (9, "15", None), (None, str(65535 << 40), None), (None, str(65535 << 40 | 1), None)]
    monkeypatch.setattr(simhash, "fingerprint", lambda text, size: text.cast("bigint"))
    found = {r["fingerprint"]: r for r in simhash.near_duplicates(odd.table(spark, rows)).collect()}
    assert [found[p]["component_id"] for p in (0, 3, 15)] == [5, 5, 5]
    alone = [found[65535 << 40 | n] for n in (0, 1)]
    assert {r["component_id"] for r in alone} == {None} and len({r["group"] for r in alone}) == 1
