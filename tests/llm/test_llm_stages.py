"""Each pipeline stage, and all of them in a row, on nulls, empty and long texts, ties and repeats."""

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
import odd  # noqa: E402
from test_llm_documents import brute_lines  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_line_stage_on_odd_rows(spark):
    docs = odd.table(spark)
    kept = corpus_pipeline.drop_shared_lines(spark, docs, SF)
    assert kept.columns == docs.columns
    want = Counter((i, text) for (i, _, _, text), n in brute_lines(odd.texts()).items() for _ in range(n))
    assert Counter((i, t or "") for (i, t), n in texts_of(kept).items() for _ in range(n)) == want
    # rows that lose nothing are as they were, a null text included
    assert texts_of(kept)[(1, None)] == 1
    assert all(r["n_chars"] == len(r["text"] or "") and r["lines"] == "clash" for r in kept.collect())


def test_toxicity_stage_on_odd_rows(spark):
    docs = odd.table(spark)
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert texts_of(kept) <= texts_of(docs)
    assert {(1, None), (2, "")} <= set(texts_of(kept))  # nothing in them is toxic


def test_packing_stage_on_odd_rows(spark):
    packed = corpus_pipeline.pack(spark, odd.table(spark), SF).collect()
    documents = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert documents == Counter(i for i, _ in odd.texts())  # null, empty and repeated ones too
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024


def test_the_whole_pipeline_on_odd_rows(spark, tmp_path):
    odd.table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, i % 2) for i in range(1, 13)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} <= {i for i, _ in odd.texts()}
    # texts without a letter have no language
    assert not {1, 2, 3, 4} & {r["doc_id"] for r in found}
    assert max(Counter((r["sequence_id"], r["offset"]) for r in found).values(), default=1) == 1


def test_the_whole_pipeline_on_empty_tables(spark, tmp_path):
    odd.table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
