"""Every operator as a named query over the test tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.clauses import (
    Clause,
    all_of,
    any_of,
    bool_match,
    fuzzy,
    in_title,
    not_,
    phrase,
    term,
    wildcard,
)
from ..functions.tokens import analyzed_tokens, joined
from ..operators import cloud, counts, filters, paging, postings
from ..plans import batch
from ..schema import CONTENT, DATE, ID, SPATIAL, SUBJECT, TITLE, articles_from_documents
from ..session import durable, shared_dir, spread
from ..sources import bulk_json, corpus, saved_queries, sinks, xml_archive
from ..streaming import ingest, running
from . import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

LOWER, UPPER = "1870-01-01", "1970-12-31"
DISTRIBUTIONS = ("sd_antilles", "sd_surinam")
TYPES = ("st_advert", "st_family")
CLAUSE = all_of(term("the"), any_of(term("and"), phrase("that this")))
SMALLEST, LARGEST = 3, 200


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Articles for queries that only filter."""
    return articles_from_documents(table(spark, sf, "documents"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles for queries that cut texts into words; spread where the session asks for it."""
    return spread(scanned(spark, sf))


#: Words that are looked up in stored term vectors; the last one stands nowhere.
STORED_WORDS = ["the", "heit", "keit", "les", "and", "zzyzx"]


def selected(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filtered_query(
        articles(spark, sf), CLAUSE, LOWER, UPPER, DISTRIBUTIONS, TYPES
    )


# --- sources ----------------------------------------------------------------------------


@query
def corpus_scan_filtered(spark, sf):
    kept = filters.date_between(LOWER, UPPER) & filters.not_excluded(DISTRIBUTIONS)
    return scanned(spark, sf).where(kept).select(ID, TITLE, CONTENT)


@query
def matching_ids(spark, sf):
    return selected(spark, sf).select(ID)


@query
def saved_query_scan(spark, sf):
    typed = saved_queries.typed(tables.stored_queries(table(spark, sf, "benchmark")))
    lists = {c: F.array_join(c, "|") for c in ("exclude_article_type", "exclude_distributions")}
    return typed.withColumns(lists)


@query
def id_pages(spark, sf):
    return paging.id_pages(scanned(spark, sf), 64)


@query
def page_offset(spark, sf):
    return paging.page(scanned(spark, sf), 30, 30)


@query
def page_late(spark, sf):
    return paging.page(scanned(spark, sf), 150, 40)


@query
def saved_query_order(spark, sf):
    """The place of each saved query in a random order that a seed fixes."""
    ids = _saved(spark, sf)[0].select("id")
    return paging.numbered(ids, saved_queries.random_key(7), "id").withColumnRenamed("n", "place")


def _stored_terms(spark: SparkSession, sf: str, by: str) -> DataFrame:
    path = shared_dir(spark)
    postings.write_doc_terms(postings.doc_terms(articles(spark, sf)), path, by=by)
    return spark.read.parquet(path)


@query
def stored_term_counts(spark, sf):
    return postings.term_counts(_stored_terms(spark, sf, "term"), STORED_WORDS)


@query
def stored_wordcloud(spark, sf):
    """The cloud of a selection from term vectors that were stored before."""
    return cloud.counts_from_frequencies(postings.terms_of(_stored_terms(spark, sf, ID), selected(spark, sf)))


@query
def doc_terms_by_ids(spark, sf):
    return postings.doc_terms(postings.terms_of(articles(spark, sf), selected(spark, sf)))


@query
def multivalue_first(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", X.first_value(lines).alias("first_value"))


def _issue_path() -> F.Column:
    key = F.col("doc_id").cast("string")
    return F.concat(F.lit("in/"), "source", F.lit("/issue."), key, F.lit(".xml.gz"))


#: A gzip file is read by one task, so their number grows with the table: one for so many bytes of it.
_XML_FILES, _XML_BYTES = 8, 32 << 20


def _xml_files(spark: SparkSession, sf: str) -> int:
    size = int(table(spark, sf, "documents")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(_XML_FILES, -(-size // _XML_BYTES))


def _write_xml(spark: SparkSession, sf: str) -> str:
    """The documents as gzip XML files; every 17th is broken and every 19th has no id.

    Every fifth has its paragraphs in CDATA sections. A root ends each file.
    """
    count = _xml_files(spark, sf)
    key = F.col("doc_id")
    label = key.cast("string")
    one = lambda name, value: F.concat(F.lit(f'<field name="{name}">'), value, F.lit("</field>"))
    plain = [n for n in xml_archive.PAPER_FIELDS if n not in ("dc_title", "dc_date", "dcx_recordIdentifier", "dc_identifier_resolver")]
    date = F.date_add(F.lit("1850-01-01").cast("date"), (key * 7919 % 51499).cast("int"))
    text = F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("]]>"), F.lit("]]&gt;"))
    between = lambda body, a, b: F.concat(
        F.lit(f"<text><p>{a}"), F.replace(body, F.lit("\n"), F.lit(f"{b}</p><p/><p>{a}")), F.lit(f"{b}</p></text>")
    )
    paragraphs = F.when(key % 5 == 0, between(F.col("text"), "<![CDATA[", "]]>")).otherwise(between(text, "", ""))
    doc = F.concat_ws(
        "\n",
        F.lit("<doc>"),
        one("dc_title", F.col("source")),
        one("dc_title", F.concat(F.lit("A & B "), label)),
        one("dc_date", date.cast("string")),
        one("dcx_recordIdentifier", F.concat(F.lit("paper:"), label)),
        F.when(key % 19 != 0, one("dcx_recordIdentifier", F.concat(F.lit("article:"), label))),
        one("dc_identifier_resolver", F.lit("paper")),
        one("dc_identifier_resolver", F.lit("article")),
        *[one(n, F.lit(n)) for n in plain],
        one("dc_subject", F.lit("artikel")),
        one("dcterms_accessRights", F.when(key % 17 == 0, "<open>").otherwise("accessible")),
        one("content", F.when(key % 23 == 0, F.lit("")).otherwise(paragraphs)),
        F.lit("</doc>"),
    )
    path = shared_dir(spark)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("part")
    docs = table(spark, sf, "documents").select(doc.alias("value"), part, F.lit(0).alias("last"))
    roots = spark.range(count).select(F.lit("</docs>").alias("value"), F.col("id").cast("int").alias("part"), F.lit(1).alias("last"))
    files = docs.unionByName(roots).repartitionByRange(count, "part").sortWithinPartitions("part", "last")
    files.select("value").write.option("compression", "gzip").text(path)
    return path


def _xml_columns(found: DataFrame) -> DataFrame:
    archive = F.rlike("zipfilename", F.lit(r"/part-[^/]*\.txt\.gz$"))
    return found.select(
        ID, "paper_dc_title", TITLE, DATE, CONTENT, "article_dc_identifier_resolver",
        "article_dcx_recordIdentifier", archive.alias("from_archive"),
    )


@query
def xml_ingest(spark, sf):
    parsed = xml_archive.parse(xml_archive.read_records(spark, _write_xml(spark, sf)))
    return _xml_columns(xml_archive.accepted(parsed))


@query
def xml_quarantine(spark, sf):
    parsed = xml_archive.parse(xml_archive.read_records(spark, _write_xml(spark, sf)))
    return xml_archive.quarantine(parsed).groupBy("status").agg(F.count(F.lit(1)).alias("docs"))


@query
def incremental_ingest(spark, sf):
    """Three files of eight in a batch, or that share of more."""
    out, state = shared_dir(spark), shared_dir(spark)
    at_once = -(-_xml_files(spark, sf) * 3 // _XML_FILES)
    ingest.ingest_new_files(spark, _write_xml(spark, sf), out, state, at_once).awaitTermination()
    return _xml_columns(ingest.ingested(spark, out))


@query
def bulk_roundtrip(spark, sf):
    path = shared_dir(spark)
    source = articles(spark, sf)
    bulk_json.write_bulk(source, path)
    return bulk_json.read_bulk(spark, path).select(*source.columns)


@query
def ingest_report(spark, sf):
    files = xml_archive.ingest_report(spark, _write_xml(spark, sf))
    return files.agg(
        F.sum("articles").alias("articles"), F.sum("rejected").alias("rejected"),
        F.count_if(F.col("status") == "unreadable").alias("unreadable"),
    )


@query
def bulk_quarantine(spark, sf):
    path, key = shared_dir(spark), F.col("doc_id")
    number = key.cast("string")
    broken = F.when(key % 13 == 0, F.concat(F.lit('{"broken '), number)).when(
        key % 29 == 0, F.concat(F.lit('{"no_id":'), number, F.lit("}"))
    )
    bad = table(spark, sf, "documents").select(broken.alias("value")).where(F.col("value").isNotNull())
    bulk_json.bulk_lines(scanned(spark, sf)).unionByName(bad).write.text(path)
    return bulk_json.bulk_quarantine(spark, path).select("line")


@query
def corpus_load(spark, sf):
    bulk, path, target = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    bulk_json.write_bulk(scanned(spark, sf), bulk)
    for _ in range(2):
        corpus.load_bulk(spark, bulk, path)
    corpus.compact_corpus(spark, path, target, 1)
    return corpus.read_corpus(spark, target, LOWER, UPPER).select(ID, DATE, SUBJECT, SPATIAL, TITLE, CONTENT)


# --- scalar functions -------------------------------------------------------------------


@query
def paragraph_join(spark, sf):
    text = X.paragraph_join(F.split("text", "\n"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text_content"))


@query
def html_unescape_basic(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_unescape(F.col("html")).alias("html"))


@query
def file_stem(spark, sf):
    path = _issue_path()
    return table(spark, sf, "documents").select(
        "doc_id", X.file_stem(path).alias("stem"), X.bulk_file_name(path).alias("bulk_name")
    )


@query
def split_exclusions(spark, sf):
    stored = tables.stored_queries(table(spark, sf, "benchmark"))
    codes = X.split_list(F.col("exclude_distributions"))
    return stored.select(
        F.col("id").cast("bigint").alias("id"), F.size(codes).cast("bigint").alias("codes"),
        F.array_join(codes, "|").alias("code_list"),
    )


@query
def run_label(spark, sf):
    label = X.run_label(F.col("source"), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", label.alias("label"))


@query
def parse_date(spark, sf):
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(key % 3 == 0, day)
        .when(key % 3 == 1, F.concat(day, F.lit("T12:30:00Z")))
        .otherwise(F.concat(F.lit("omstreeks "), day))
    )
    return table(spark, sf, "orders").select("o_orderkey", X.parse_date(text).alias("parsed"))


# --- tokenisers and counts --------------------------------------------------------------


@query
def wordcount_raw(spark, sf):
    return counts.word_counts(articles(spark, sf), (CONTENT,), "raw")


@query
def wordcount_clean(spark, sf):
    return counts.word_counts(articles(spark, sf), (CONTENT,), "stripped", 2)


@query
def analyzed_terms(spark, sf):
    return counts.word_counts(articles(spark, sf), (CONTENT,), "analyzed")


@query
def tokens_per_doc(spark, sf):
    return articles(spark, sf).select(ID, counts.token_count().alias("tokens"))


@query
def doc_terms(spark, sf):
    return postings.doc_terms(articles(spark, sf))


@query
def merge_counts(spark, sf):
    source = articles(spark, sf)
    parts = [counts.word_counts(source, (field,), "stripped", 2) for field in (TITLE, CONTENT)]
    return counts.merge_counts(*parts)


@query
def corpus_stats(spark, sf):
    return counts.corpus_stats(articles(spark, sf))


@query
def corpus_stats_avg(spark, sf):
    return counts.average_words(selected(spark, sf))


@query
def articles_per_source(spark, sf):
    return counts.articles_per_source(table(spark, sf, "documents"), "source")


@query
def counts_sink(spark, sf):
    path = shared_dir(spark)
    sinks.write_counts(counts.word_counts(articles(spark, sf), (CONTENT,), "raw"), path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("term"), F.get(parts, F.lit(1)).cast("bigint").alias("count")
    )


@query
def streaming_wordcount(spark, sf):
    path, state = shared_dir(spark), shared_dir(spark)
    stored = table(spark, sf, "documents")
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf}/documents.parquet*")
    running.start_running_counts(
        articles_from_documents(stream), path, state, fields=(CONTENT,), min_length=2
    ).awaitTermination()
    return running.latest_counts(spark.read.parquet(path))


@query
def running_wordcloud(spark, sf):
    """The cloud of a stream of selected articles, in several micro-batches.

    Half of the files come in after the first run has ended; the second one goes on from its state.
    """
    inbox, path, state = (shared_dir(spark) for _ in range(3))
    docs = table(spark, sf, "documents")
    for half in range(2):
        coming = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half)
        coming.repartition(4, "doc_id").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
        found = filters.filtered_query(articles_from_documents(stream), CLAUSE, LOWER, UPPER, DISTRIBUTIONS, TYPES)
        running.start_running_cloud(found, path, state, min_length=2).awaitTermination()
    return running.ranking(spark, path)


# --- filters ----------------------------------------------------------------------------


@query
def filter_date_range(spark, sf):
    return scanned(spark, sf).where(filters.date_between(LOWER, UPPER)).select(ID, DATE)


@query
def filter_exclude(spark, sf):
    kept = filters.not_excluded(DISTRIBUTIONS, TYPES)
    return scanned(spark, sf).where(kept).select(ID, SUBJECT, SPATIAL)


@query
def filtered_query(spark, sf):
    return selected(spark, sf).select(ID, DATE, SUBJECT, SPATIAL, TITLE)


CLAUSES: dict[str, Clause] = {
    "match_term": term("Heit"),
    "match_any": any_of(term("heit keit"), term("oion"), term("ande-anre"), term("ung or pas")),
    "match_all": all_of(term("the"), term("and"), term("this")),
    "match_not": all_of(term("the"), not_(term("with"))),
    "match_grouped": any_of(
        all_of(term("heit"), term("keit")), all_of(any_of(term("la"), term("les")), not_(term("un")))
    ),
    "match_bool": any_of(
        bool_match(must=[term("the"), term("and")], should=[term("la")], must_not=[term("by")]),
        bool_match(must=[term("de")], should=[term("les")], must_not=[term("un")]),  # "de" is a stop word
    ),
    "match_phrase": any_of(phrase("and the"), phrase("the of with"), phrase('"modern*"')),
    "match_prefix": wildcard("ung*"),
    "match_wildcard": any_of(wildcard("*heitkeit"), wildcard("th?nt*"), wildcard("*ßü*"), wildcard("a*ti?n"), wildcard("ver*~")),
    "match_fuzzy": any_of(fuzzy("ander", 1), fuzzy("heitkeit"), fuzzy("oionai", 2)),
    "match_title": in_title(any_of(term("the"), phrase("de la"))),
}


def _matching(clause: Clause) -> Query:
    return lambda spark, sf: filters.search(articles(spark, sf), clause).select(ID)


_QUERIES |= {name: _matching(clause) for name, clause in CLAUSES.items()}


@query
def match_diacritics(spark, sf):
    """Letters written with a combining accent, in the articles and in the query."""
    split = F.replace(F.col(CONTENT), F.lit("é"), F.lit("e\u0301"))
    clause = any_of(term("E\u0301T"), phrase("re\u0301 de la"), wildcard("que?e\u0301*"))
    return filters.search(articles(spark, sf).withColumn(CONTENT, split), clause).select(ID)


@query
def count_matches(spark, sf):
    return selected(spark, sf).agg(F.count(F.lit(1)).alias("count"))


# --- word clouds ------------------------------------------------------------------------


@query
def wordcloud_mr(spark, sf):
    return cloud.cloud_from_texts(selected(spark, sf))


@query
def wordcloud_tv(spark, sf):
    return cloud.counts_from_frequencies(postings.doc_terms(selected(spark, sf)))


@query
def wordcloud_stopwords(spark, sf):
    words = table(spark, sf, "benchmark").select(
        F.explode(analyzed_tokens(F.col("text"))).alias("term")
    )
    counted = counts.word_counts(articles(spark, sf), min_length=2)
    return cloud.without_stop_words(counted, words.distinct())


@query
def wordcloud_response(spark, sf):
    counted = counts.word_counts(selected(spark, sf), min_length=2)
    return cloud.cloud_response(counted).withColumn("result", F.to_json("result"))


# --- saved queries ----------------------------------------------------------------------


def _saved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    passages = table(spark, sf, "benchmark")
    return saved_queries.typed(tables.stored_queries(passages)), tables.stored_clauses(passages)


def _batch(spark: SparkSession, sf: str) -> batch.BatchResult:
    queries, clauses = _saved(spark, sf)
    return batch.run_batch(
        articles(spark, sf), queries, clauses, smallest=SMALLEST, largest=LARGEST
    )


def _ungated(spark: SparkSession, sf: str) -> batch.BatchResult:
    queries, clauses = _saved(spark, sf)
    return batch.run_batch(articles(spark, sf), queries, clauses, None, None, tokeniser="stripped")


@query
def query_json(spark, sf):
    return saved_queries.as_json(_saved(spark, sf)[0])


@query
def decode_exclusions(spark, sf):
    return saved_queries.decode_exclusions(_saved(spark, sf)[0])


@query
def saved_query_counts(spark, sf):
    return _batch(spark, sf).counts.select("query_id", "count")


@query
def bucketed_query_counts(spark, sf):
    """The counts of all saved queries over a stored corpus, bucketed by id, that holds its words."""
    path = shared_dir(spark)
    name = f"articles_{path.rsplit('/', 1)[-1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    corpus.save_bucketed(filters.with_words(articles(spark, sf)), name, buckets, path)
    queries, clauses = _saved(spark, sf)
    return batch.run_batch(spark.table(name), queries, clauses, None, None).counts.select("query_id", "count")


@query
def query_size_gate(spark, sf):
    return _batch(spark, sf).counts.select("query_id", "status")


@query
def saved_query_wordcloud(spark, sf):
    return _batch(spark, sf).clouds


@query
def saved_query_wordcloud_mr(spark, sf):
    """Word clouds of stripped words for all saved queries, without a gate."""
    return _ungated(spark, sf).clouds


@query
def saved_query_wordcloud_all(spark, sf):
    """Word clouds of analysed words for all saved queries, without a gate."""
    queries, clauses = _saved(spark, sf)
    return batch.run_batch(articles(spark, sf), queries, clauses, None, None, tokeniser="analyzed").clouds


@query
def saved_query_stats(spark, sf):
    queries, _ = _saved(spark, sf)
    result = _ungated(spark, sf)
    return batch.query_stats(result.articles, queries, result.matches)


@query
def saved_query_patterns(spark, sf):
    queries, _ = _saved(spark, sf)
    clauses = tables.pattern_clauses(table(spark, sf, "benchmark"))
    result = batch.run_batch(articles(spark, sf), queries, clauses, None, None)
    return result.counts.select("query_id", "count")


@query
def result_log(spark, sf):
    path, start = shared_dir(spark), time.perf_counter()
    counted = durable(_batch(spark, sf).counts)
    done = counted.select(
        X.run_label(F.lit("run"), F.lit("documents")).alias("identifier"),
        F.col("query_id").alias("queryid"), "status", "count",
        F.lit(time.perf_counter() - start).alias("time"),
    )
    sinks.append_results(done, path)
    return spark.read.parquet(path).select(
        "identifier", "queryid", "status", "count", (F.col("time") > 0).alias("timed")
    )


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
