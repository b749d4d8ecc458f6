"""Invariants, edge cases and plans of the counting operators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.clauses import all_of, not_, phrase, term
from broadsheet.operators import cloud, counts, filters, paging, postings
from broadsheet.plans import batch
from broadsheet.schema import articles_from_documents
from broadsheet.session import shared_dir

SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def articles(spark):
    return articles_from_documents(spark.read.parquet(SMALL))


def as_counter(df):
    return Counter({r["term"]: r["count"] for r in df.collect()})


def test_words_add_up(articles):
    total = {r["key"]: r["value"] for r in counts.corpus_stats(articles).collect()}
    assert sum(as_counter(counts.word_counts(articles)).values()) == total["nrWords"]
    assert total["nrDocs"] == articles.count()
    mean = counts.average_words(articles).first()[0]
    assert mean == pytest.approx(total["nrWords"] / total["nrDocs"])


def test_term_frequencies_equal_direct_counts(articles):
    direct = as_counter(counts.word_counts(articles, tokeniser="analyzed", min_length=2))
    assert as_counter(cloud.counts_from_frequencies(postings.doc_terms(articles))) == direct


def test_top_terms_are_part_of_the_counts(articles):
    every = as_counter(counts.word_counts(articles, min_length=2))
    top = [(r["term"], r["count"]) for r in cloud.cloud_from_texts(articles, 20).collect()]
    assert top == sorted(every.items(), key=lambda e: (-e[1], e[0]))[:20]


def test_chunks_add_up_to_the_whole(articles):
    key = F.pmod(F.xxhash64("identifier"), F.lit(3))
    parts = [counts.word_counts(articles.where(key == i)) for i in range(3)]
    assert as_counter(counts.merge_counts(*parts)) == as_counter(counts.word_counts(articles))


def test_nothing_to_count(articles):
    none = articles.where(F.lit(False))
    response = cloud.cloud_response(counts.word_counts(none)).first()
    assert (response["max_count"], response["result"], response["status"]) == (None, [], "ok")
    assert counts.average_words(none).first()[0] is None
    assert [r["value"] for r in counts.corpus_stats(none).collect()] == [0, 0]
    assert paging.id_pages(none, 10).count() == 0


def test_response(spark):
    counted = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "term string, count bigint")
    row = cloud.cloud_response(counted, 2).first()
    assert row["max_count"] == 9 and row["burstcloud"] is False
    assert [(e["term"], e["count"]) for e in row["result"]] == [("c", 9), ("a", 2)]
    stop = spark.createDataFrame([("c",), ("zz",)], "term string")
    assert as_counter(cloud.without_stop_words(counted, stop)) == {"a": 2, "b": 2}


def test_doc_terms_of_odd_rows(spark):
    rows = [("1", "De de", None, "b a b a b"), ("2", "", "x", None)]
    df = spark.createDataFrame(
        rows, "identifier string, article_dc_title string, paper_dc_title string, text_content string"
    )
    got = {(r["identifier"], r["field"], r["term"]): r["tf"] for r in postings.doc_terms(df).collect()}
    assert got == {("1", "text_content", "a"): 2, ("1", "text_content", "b"): 3, ("2", "paper_dc_title", "x"): 1}


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_pages(spark, size):
    ids = spark.range(351).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("identifier"))
    pages = paging.id_pages(ids.unionByName(ids.where("identifier = '00007'")), size).collect()
    assert sorted((r["identifier"], r["page"]) for r in pages) == [(f"{i:05d}", i // size) for i in range(351)]


def test_deep_pages_read_their_partitions_only(spark, plan_of):
    ids = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("identifier"))
    ids = ids.unionByName(ids.where("identifier < '00020'"))
    every = sorted(r["identifier"] for r in ids.collect())
    with_parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = paging.position_index(ids, "identifier")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    parts = index.select("part").distinct().count()
    assert parts > 4
    for offset, size in ((0, 5), (7, 900), (1990, 30), (2015, 30), (2020, 5), (0, 5000), (3, 0)):
        found = [r["identifier"] for r in paging.slice_of(index, offset, size).collect()]
        assert found == every[offset : offset + size]
    late = paging.slice_of(index, 1990, 5)
    plan = plan_of(late)
    assert "TakeOrdered" not in plan and "PartitionFilters: [isnotnull(part" in plan
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    held = {r["part"] for r in index.where(F.col("identifier").isin(every[1990:1995])).collect()}
    # the sort of the page samples its input first, so the scan counts twice
    assert 5 <= rows_read(late) <= 2 * sum(sizes[p] for p in held) < 2020


def rows_read(df):
    """Rows that the scan of a plan has put out."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.getActiveSession().sparkContext._jvm
    run = df._jdf.queryExecution()
    df._jdf.collectToPython()
    plan = run.executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    while plan.children().size() or plan.nodeName().endswith("QueryStage"):
        plan = plan.plan() if plan.nodeName().endswith("QueryStage") else plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_a_word_is_looked_up_in_few_rows(spark, articles, plan_of):
    path = shared_dir(spark)
    terms = postings.doc_terms(articles)
    postings.write_doc_terms(terms, path, 8)
    stored = spark.read.parquet(path)
    total = stored.count()
    frequent = stored.groupBy("term").count().orderBy(F.desc("count")).first()["term"]
    one = postings.term_counts(stored, [frequent])
    assert "PushedFilters: [IsNotNull(term), EqualTo(term," in plan_of(one) or "PushedFilters: [In(term" in plan_of(one)
    assert one.collect() == postings.term_counts(terms, [frequent]).collect()
    assert 0 < rows_read(stored.where(F.col("term") == frequent)) <= total / 3
    assert rows_read(stored.where(F.col("term") == frequent + "\u0001")) == 0  # within the span of a file
    assert postings.term_counts(stored, ["no such word"]).collect() == []


def test_size_gate(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 9999, 10000, 50000, 50001)], "count bigint")
    status = [r["status"] for r in filters.size_gate(sizes).orderBy("count").collect()]
    assert status == ["too_few", "too_few", "ok", "ok", "too_many"]


def test_stored_terms_are_found_by_file_statistics(spark, articles):
    path = shared_dir(spark)
    postings.write_doc_terms(postings.doc_terms(articles), path, 4)
    stored = spark.read.parquet(path)
    assert stored.count() == postings.doc_terms(articles).count()
    assert postings.vocabulary(stored).count() == stored.select("term").distinct().count()


# --- plans ------------------------------------------------------------------------------


def test_counts_stay_inside_the_jvm(articles, plan_of):
    for tokeniser in counts.TOKENISERS:
        plan = plan_of(counts.top_terms(counts.word_counts(articles, tokeniser=tokeniser)))
        assert "TakeOrderedAndProject" in plan and "partial_count" in plan
        assert "Python" not in plan and plan.count("Exchange") == 1


def test_term_frequencies_are_not_shuffled(articles, plan_of):
    assert "Exchange" not in plan_of(postings.doc_terms(articles))


def test_words_are_cut_once(articles, plan_of):
    clause = all_of(term("the"), phrase("of the"), not_(term("and")), term("with"))
    plan = plan_of(filters.search(articles, clause))
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan


def test_unused_columns_are_not_read(articles, plan_of):
    plan = plan_of(articles.where(filters.date_between("1900-01-01", "1910-01-01")).select("identifier"))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_clouds_limit_each_query_before_the_shuffle(spark, articles, plan_of):
    matches = articles.select(F.lit(1).alias("query_id"), "identifier")
    plan = plan_of(batch.query_clouds(articles, matches))
    assert "WindowGroupLimit" in plan and "partial_sum" in plan


def test_clouds_from_stored_terms_are_the_same(articles):
    matches = articles.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_id"), "identifier")
    stored = postings.doc_terms(articles)
    direct = batch.query_clouds(articles, matches, 50).collect()
    assert sorted(batch.query_clouds(articles, matches, 50, terms=stored).collect()) == sorted(direct)


def test_exclusions_reach_the_scan(spark, articles, plan_of):
    path = shared_dir(spark)
    articles.write.parquet(path)
    plan = plan_of(spark.read.parquet(path).where(filters.not_excluded(["sd_surinam"])))
    assert "PushedFilters: [Or(IsNull(paper_dcterms_spatial),Not(" in plan


def test_stored_terms_cut_each_text_once(spark, tmp_path):
    """The bounds of the sorted files come from stored terms, not from the texts again (F15)."""
    from pyspark.sql import functions as F

    from broadsheet.operators import postings

    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    source = spark.createDataFrame([(str(i), f"film __ de radio w{i} film") for i in range(40)], "identifier string, t string")
    texts = source.select("identifier", F.udf(seen, "string")("t").alias("text_content"))
    postings.write_doc_terms(postings.doc_terms(texts, ("text_content",)), str(tmp_path / "terms"), 4)
    assert read.value == 40
    stored = spark.read.parquet(str(tmp_path / "terms"))
    assert sorted(tuple(r) for r in postings.term_counts(stored, ["film", "de", "__", "w7"]).collect()) == [
        ("film", 40, 80), ("w7", 1, 1),
    ]
