import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
import numpy as np  # noqa: E402
import odd  # noqa: E402
import pytest  # noqa: E402
from oracle import connect, difference  # noqa: E402

import __spark_entry__  # noqa: E402
from broadsheet.llm import language, queries, simhash, sql  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert found["pipeline"] is corpus_pipeline.run
    assert set(sql.oracle_sql()) <= set(queries.queries())


def test_stages_on_the_test_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(n))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        now = {r["doc_id"]: r for r in docs.collect()}
        assert set(now) <= set(before)
        if name == "language_id":
            assert len(now) >= 0.98 * len(before)
            assert all(any(c.isalpha() for c in r["text"]) for r in now.values())
        if name == "toxicity":
            gone = set(before) - set(now)
            assert sum(labels.get(i) == 0 for i in gone) <= 0.005 * len(before)
        if name == "line_dedup":
            assert set(now) == set(before)
            assert all(r["n_chars"] == len(r["text"]) for i, r in now.items() if r["text"] != before[i]["text"])
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(spark.createDataFrame(list(before.values()), docs.schema))
            assert set(now) == {r["component_id"] for r in groups.collect()}
        before = now
    assert {r["doc_id"] for r in docs.collect()} == set(before)


def test_stages_on_odd_rows(spark):
    docs = odd.table(spark)
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns
    dedup = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    rows = Counter((r["doc_id"], r["text"]) for r in dedup.collect())
    assert max(rows.values()) == 1 and (6, "the same text in two rows") in rows
    assert (None, "no id, but a text of its own") in rows and (7, "the same text in two rows") not in rows
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.table(spark, []), SF).count() == 0


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    assert difference(spark, connect(SF), SF, name) == ""


@pytest.mark.parametrize("name", ["op1_language_id", "op2_toxicity", "op3_byte_bpe", "op5_byte_shards", "op8_token_counts", "op9_simhash"])
def test_every_document_has_one_row(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.queries()[name](spark, SF)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_byte_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
}


def invented(rng, letters, words, texts):
    """Texts of a language that has its own words, made of its own syllables."""
    syllables = ["".join(rng.choice(list(letters), 2)) for _ in range(30)]
    lexicon = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(150)]
    return [" ".join(rng.choice(lexicon, words)) for _ in range(texts)]


@pytest.mark.parametrize("n_languages", [2, 4, 8])
def test_texts_of_no_learned_language_go(spark, n_languages):
    rng = np.random.default_rng(n_languages)
    latin, greek, cyrillic = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "бвгдежзийклмнопрстуфхцч"
    rows = [
        (f"lang{n}", text)
        for n in range(n_languages)
        for text in invented(rng, greek if n % 4 == 3 else latin, int(rng.integers(20, 60)), 80)
    ]
    junk = [" ".join("".join(rng.choice(list(latin), int(rng.integers(3, 9)))) for _ in range(30)) for _ in range(12)]
    # a few of them have a wrong label, so training sees them
    rows += [("lang0" if n % 6 == 0 else None, text) for n, text in enumerate(junk + invented(rng, cyrillic, 30, 12))]
    full = [(i, text, lang) for i, (lang, text) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert kept == set(range(80 * n_languages))


def test_stages_start_no_more_python_workers_than_tasks(spark, plan_of, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"some words of text {i}", "en" if i % 2 else "nl", "web") for i in range(20)],
        "doc_id bigint, text string, lang string, source string",
    )
    plans, collect = [], type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda df: plans.append(plan_of(df)) or collect(df))
    model = language.fit(docs)
    assert model.languages == ["en", "nl"]
    assert [p.count("ArrowEvalPython") for p in plans] == [1]
    # rules given as a list of rows would be read by workers of another kind
    assert "ExistingRDD" not in plan_of(corpus_pipeline.pack(spark, docs, SF))
