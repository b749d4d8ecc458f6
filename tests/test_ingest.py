import gzip
from datetime import date

import pytest
from pyspark.sql import functions as F

from broadsheet.schema import ARTICLE_COLUMNS, ARTICLE_SCHEMA, PAPER_FIELDS
from broadsheet.sources import bulk_json, corpus, saved_queries, sinks, xml_archive
from broadsheet.streaming import ingest, running


def doc(n, content="<text><p>een &amp; twee</p><p/><p>drie</p></text>", title="Title & subtitle", extra="", skip=()):
    names = list(PAPER_FIELDS) + ["dc_subject", "dcterms_accessRights"]
    values = {"dc_title": f"Paper {n}", "dc_date": "1950-01-01", "dcx_recordIdentifier": f"paper:{n}"}
    lines = [f'<field name="{f}">{values.get(f, f)}</field>' for f in names if f not in skip]
    lines += [
        f'<field name="dc_title">{title}</field>',
        f'<field name="dcx_recordIdentifier">article:{n}</field>',
        '<field name="dc_identifier_resolver">second</field>',
    ]
    return "<doc>\n" + "\n".join(lines) + extra + f'\n<field name="content">{content}</field>\n</doc>\n'


def write(path, *docs):
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write('<?xml version="1.0"?>\n<docs>\n' + "".join(docs) + "</docs>\n")


@pytest.fixture
def archive(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(
        folder / "a.xml.gz",
        doc(1),
        doc(2, content=""),
        doc(3, title="Caf&eacute; &amp; bar", content="<text><p>a&#233;b &lt;i&gt; &amp;lt;</p><p>x<b>y</b>z</p></text>"),
        doc(4, extra="<field>broken</fiel>"),
        doc(5, skip=("dc_source",)),
    )
    write(folder / "b.xml.gz", doc(6, content="<text></text>"), doc(7, content="<text><p>zeven</p></text>"))
    return folder


def test_xml_articles(spark, archive):
    parsed = xml_archive.parse(xml_archive.read_records(spark, str(archive)))
    got = {r["identifier"]: r for r in xml_archive.accepted(parsed).collect()}
    assert set(got) == {f"article:{n}" for n in (1, 2, 3, 6, 7)}
    one = got["article:1"]
    assert one["paper_dc_title"] == "Paper 1" and one["article_dc_title"] == "Title & subtitle"
    assert one["paper_dc_date"] == date(1950, 1, 1)
    assert one["text_content"] == "een & twee\n\ndrie"
    assert one["paper_dc_identifier_resolver"] == "dc_identifier_resolver"
    assert one["article_dc_identifier_resolver"] == "second"
    assert one["article_dcx_recordIdentifier"] == one["identifier"]
    assert one["paper_dcx_recordIdentifier"] == "paper:1"
    assert one["zipfilename"].endswith("/a.xml.gz")
    assert got["article:2"]["text_content"] == got["article:6"]["text_content"] == ""
    assert got["article:3"]["text_content"] == "aéb <i> &lt;\n\nx"
    assert got["article:3"]["article_dc_title"] == "Caf&eacute; &amp; bar"
    assert len(ARTICLE_COLUMNS) == 27


def test_quarantine_holds_only_the_bad_documents(spark, archive):
    parsed = xml_archive.parse(xml_archive.read_records(spark, str(archive)))
    bad = {r["status"]: r for r in xml_archive.quarantine(parsed).collect()}
    assert set(bad) == {"malformed", "missing_field"}
    assert "article:4" in bad["malformed"]["rejected_xml"]


def test_bulk_round_trip(spark, archive, tmp_path):
    articles = xml_archive.accepted(xml_archive.parse(xml_archive.read_records(spark, str(archive))))
    out = str(tmp_path / "bulk")
    bulk_json.write_bulk(articles, out)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert len(lines) == 10 and '{"index":{"_id":"article:1"}}' in lines
    again = bulk_json.read_bulk(spark, out)
    assert again.schema == ARTICLE_SCHEMA
    assert sorted(again.collect()) == sorted(articles.collect())
    corpus.load_bulk(spark, out, str(tmp_path / "corpus"))
    loaded = corpus.read_corpus(spark, str(tmp_path / "corpus"))
    assert sorted(loaded.select(*ARTICLE_COLUMNS).collect()) == sorted(articles.collect())


def test_only_new_files_are_ingested(spark, archive, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: ingest.ingest_new_files(spark, str(archive), out, state).awaitTermination()
    run()
    first = {r["identifier"]: r["paper_dc_title"] for r in ingest.ingested(spark, out).collect()}
    assert len(first) == 5 and ingest.rejected(spark, out).count() == 2
    write(archive / "c.xml.gz", doc(8))
    assert names(ingest.converted_files(spark, out)) == {"a.xml.gz", "b.xml.gz"}
    assert names(ingest.unfinished(spark, str(archive), out)) == {"c.xml.gz"}
    run()
    run()
    assert ingest.ingested(spark, out).count() == 6
    assert ingest.unfinished(spark, str(archive), out).count() == 0
    assert ingest.read_again(spark, str(archive), out).count() == 0


def test_cdata_is_kept_whole(spark, tmp_path):
    content = "<text><p><![CDATA[a < b c & d &amp; ]]></p><p>x<b>y</b> &lt;</p><p><![CDATA[]]></p><p>p<![CDATA[<q>]]>r</p></text>"
    write(tmp_path / "a.xml.gz", doc(1, content=content), doc(2, content="<text><p><![CDATA[open</p></text>"))
    parsed = xml_archive.parse(xml_archive.read_records(spark, str(tmp_path / "a.xml.gz"))).collect()
    got = {r["status"]: r for r in parsed}
    assert set(got) == {"ok", "malformed", "complete"}
    assert got["ok"]["text_content"] == "a < b c & d &amp; \n\nx\n\np<q>r"
    assert "malformed" in got


def damage(folder):
    whole = (folder / "b.xml.gz").read_bytes()
    (folder / "cut off.xml.gz").write_bytes(whole[: len(whole) * 2 // 3])
    (folder / "no gzip.xml.gz").write_bytes(b"<docs>plain</docs>")
    with gzip.open(folder / "none.xml.gz", "wt") as out:
        out.write("<docs></docs>")
    write(folder / "only rejects.xml.gz", doc(9, extra="<field>broken</fiel>"))


def names(rows):
    from urllib.parse import unquote

    return {unquote(r["zipfilename"]).rsplit("/", 1)[1] for r in rows.collect()}


def test_one_bad_file_does_not_stop_the_others(spark, archive, tmp_path):
    damage(archive)
    path = str(archive)
    parsed = xml_archive.parse(xml_archive.read_records(spark, path))
    ids = {r["identifier"] for r in xml_archive.accepted(parsed).collect()}
    assert {f"article:{n}" for n in (1, 2, 3, 6, 7)} <= ids
    assert names(xml_archive.unfinished_files(spark, path, parsed)) == {"cut off.xml.gz", "no gzip.xml.gz"}
    report = {names_of(r): (r["articles"], r["rejected"], r["status"]) for r in xml_archive.ingest_report(spark, path).collect()}
    assert report["a.xml.gz"] == (3, 2, "ok") and report["only rejects.xml.gz"] == (0, 1, "ok")
    assert report["none.xml.gz"] == (0, 0, "empty") and report["no gzip.xml.gz"] == (0, 0, "unreadable")
    assert names(xml_archive.completed_files(parsed)) == {"a.xml.gz", "b.xml.gz", "none.xml.gz", "only rejects.xml.gz"}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.ingest_new_files(spark, path, out, state).awaitTermination()
    assert {f"article:{n}" for n in (1, 2, 3, 6, 7)} <= {r["identifier"] for r in ingest.ingested(spark, out).collect()}


def fail_reading(path, at):
    """Make local reads of an intact file fail from this byte on: a checksum beside it is wrong."""
    import struct
    import zlib as z

    data = path.read_bytes()
    sums = [z.crc32(data[i : i + 512]) ^ (i // 512 >= at // 512) for i in range(0, len(data), 512)]
    crc = path.with_name(f".{path.name}.crc")
    crc.write_bytes(b"crc\0" + struct.pack(">i", 512) + b"".join(struct.pack(">I", n) for n in sums))
    return crc


def test_a_read_error_of_an_intact_file_is_seen_and_read_again(spark, archive, tmp_path):
    import random

    noise = lambda n: "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz ", k=3000))
    write(archive / "big.xml.gz", *[doc(100 + n, content=f"<text><p>{noise(n)}</p></text>") for n in range(200)])
    broken = fail_reading(archive / "big.xml.gz", 250_000)
    path, out, state = str(archive), str(tmp_path / "out"), str(tmp_path / "state")
    parsed = xml_archive.parse(xml_archive.read_records(spark, path))
    report = {names_of(r): (r["articles"], r["status"]) for r in xml_archive.ingest_report(spark, path).collect()}
    assert 0 < report["big.xml.gz"][0] < 200 and report["big.xml.gz"][1] == "unreadable"
    assert names(xml_archive.unfinished_files(spark, path, parsed)) == {"big.xml.gz"}
    run = lambda: ingest.ingest_new_files(spark, path, out, state).awaitTermination()
    run()
    before = ingest.ingested(spark, out).count()
    assert 5 < before < 205 and names(ingest.read_again(spark, path, out)) == {"big.xml.gz"}
    assert ingest.ingested(spark, out).count() == before
    broken.unlink()  # the file itself was whole all the time
    run()
    assert ingest.ingested(spark, out).count() == before and names(ingest.unfinished(spark, path, out)) == {"big.xml.gz"}
    assert ingest.read_again(spark, path, out).count() == 0
    assert ingest.ingested(spark, out).count() == 205 and ingest.rejected(spark, out).count() == 2
    assert "big.xml.gz" in names(ingest.converted_files(spark, out))


def test_the_end_of_a_file_is_not_an_end_inside_it(spark, tmp_path):
    texts = {
        "whole": "<r><doc><a>x</a></doc></r>", "blank after": "<r><doc><a>x</a></doc></r>\n \n", "empty": "<r></r>",
        "open document": "<r><doc><a>x</a></doc><doc><a b='1'>x</a></r>", "only open": "<r><doc><a>x</a></r>",
        "no root end": "<r><doc><a>x</a></doc>", "inside": "<r><doc><a>x</a></doc><doc><a>x</a>", "inside tag": "<r><doc><a>x</a></doc></r",
        "attribute": "<r><doc><a b='1'>x</a>", "nothing": "",
    }
    for name, text in texts.items():
        with gzip.open(tmp_path / f"{name}.gz", "wt") as out:
            out.write(text)
    found = xml_archive.read_records(spark, str(tmp_path)).where("complete")
    assert names(found) == {f"{n}.gz" for n in ("whole", "blank after", "empty", "open document", "only open")}


def names_of(row):
    from urllib.parse import unquote

    return unquote(row["zipfilename"]).rsplit("/", 1)[1]


def test_broken_bulk_lines_are_set_aside(spark, tmp_path):
    good = some_articles(spark, 3)
    bulk_json.write_bulk(good, str(tmp_path / "bulk"))
    (tmp_path / "bulk" / "more.json").write_text('{"identifier": "x", "text_con\n{"title": "no id"}\n\n{"delete":{"_id":"1"}}\n')
    lines = {r["line"] for r in bulk_json.bulk_quarantine(spark, str(tmp_path / "bulk")).collect()}
    assert lines == {'{"identifier": "x", "text_con', '{"title": "no id"}'}
    assert bulk_json.read_bulk(spark, str(tmp_path / "bulk")).count() == 3


def test_a_second_load_replaces(spark, tmp_path):
    path = str(tmp_path / "corpus")
    first = some_articles(spark, 20)
    corpus.upsert(first, path)
    corpus.upsert(first, path)
    moved = first.where("identifier in ('1', '5', '9', '13', '17')").withColumns(
        {"paper_dc_date": F.lit("1955-01-01").cast("date"), "article_dc_title": F.lit("nieuw"), "zipfilename": F.lit("a")}
    )
    corpus.upsert(moved.unionByName(moved), path)
    stored = corpus.read_corpus(spark, path).collect()
    assert len(stored) == len({r["identifier"] for r in stored}) == 20
    assert {r["identifier"] for r in stored if r["article_dc_title"] == "nieuw"} == {"1", "5", "9", "13", "17"}
    assert "1901" not in corpus.current(spark, path).years
    corpus.upsert(first.where("identifier = '1'").withColumn("paper_dc_date", F.lit(None).cast("date")), path)
    assert corpus.read_corpus(spark, path).where("paper_dc_date is null").count() == 1


def test_a_load_that_fails_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "corpus")
    first = some_articles(spark, 20)
    corpus.upsert(first, path)
    begun = corpus.read_corpus(spark, path)
    changed = first.withColumns({"article_dc_title": F.lit("nieuw"), "paper_dc_date": F.lit("1955-01-01").cast("date")})
    titles = lambda df: sorted((r["identifier"], r["article_dc_title"]) for r in df.collect())
    before = titles(begun)

    def broken(*_):
        raise OSError("the driver dies between the two steps")

    publish = corpus._publish
    for load in (lambda: corpus.upsert(changed, path), lambda: corpus.compact_corpus(spark, path, files=1)):
        with monkeypatch.context() as patch:
            patch.setattr(corpus, "_publish", broken)
            with pytest.raises(OSError):
                load()
        assert titles(corpus.read_corpus(spark, path)) == before
    # a load that began before another one was published stops instead of undoing it
    state = corpus.current(spark, path)
    corpus.upsert(changed, path)
    with pytest.raises(Exception, match="FileAlreadyExists"):
        publish(spark, path, state, state.schema, state.years)
    after = titles(corpus.read_corpus(spark, path))
    assert after == sorted((i, "nieuw") for i, _ in before)
    assert titles(begun) == before  # its folders are still there
    corpus.compact_corpus(spark, path, files=1)
    assert corpus.remove_unused(spark, path) >= 4
    assert titles(corpus.read_corpus(spark, path)) == after
    assert len(list((tmp_path / "corpus").glob("load=*"))) == len(list((tmp_path / "corpus/_pointers").glob("*.json"))) == 1
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="another type"):
        corpus.write_corpus(changed.withColumn("article_dc_title", F.lit(1)), path)


def test_an_upsert_adds_columns_and_takes_nothing(spark, tmp_path):
    path = str(tmp_path / "corpus")
    first = some_articles(spark, 8)
    corpus.upsert(first, path)
    corpus.upsert(first.where("identifier = '3'").withColumn("extra", F.lit("x")), path)
    corpus.upsert(first.limit(0), path)
    assert {(r["identifier"], r["extra"]) for r in corpus.read_corpus(spark, path).collect()} == {
        (str(i), "x" if i == 3 else None) for i in range(8)
    }


def test_total_is_told_from_a_missing_source(spark):
    from broadsheet.operators.counts import articles_per_source

    rows = spark.createDataFrame([("a",), ("a",), (None,)], "zipfilename string")
    found = {tuple(r) for r in articles_per_source(rows).collect()}
    assert found == {(None, 1, False), (None, 3, True), ("a", 2, False)}


def test_shared_folder(spark, monkeypatch):
    from broadsheet import session

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_base(Session)
    monkeypatch.setattr(session, "_WRITTEN", [])
    kept = session.durable(spark.range(3))
    assert kept.count() == 3 and session.release(spark) == 1 and session.release(spark) == 0


def some_articles(spark, n=60):
    key = F.col("id")
    return spark.range(n).select(
        key.cast("string").alias("identifier"),
        F.concat(F.lit("titel "), key % 3).alias("article_dc_title"),
        F.lit("Krant").alias("paper_dc_title"),
        F.concat(F.lit("woord "), key % 5, F.lit(" woord")).alias("text_content"),
        F.date_add(F.lit("1900-06-01").cast("date"), (key % 4 * 365).cast("int")).alias("paper_dc_date"),
        F.lit("file").alias("zipfilename"),
    )


def test_corpus_by_year(spark, tmp_path, plan_of):
    path, target = str(tmp_path / "corpus"), str(tmp_path / "compact")
    articles = some_articles(spark)
    for part in (0, 1):
        corpus.write_corpus(articles.where(F.pmod(F.xxhash64("identifier"), F.lit(2)) == part), path)
    corpus.compact_corpus(spark, path, target, 1)
    stored = corpus.read_corpus(spark, target)
    assert sorted(stored.select(*articles.columns).collect()) == sorted(articles.collect())
    assert len(list((tmp_path / "compact").glob("load=*/year=*/*.parquet"))) == 4
    some = corpus.read_corpus(spark, target, "1901-01-01", "1902-12-31")
    plan = plan_of(some)
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(paper_dc_date)" in plan
    assert some.count() == 30


def test_a_repeated_id_keeps_its_last_file(spark):
    older = some_articles(spark).withColumn("zipfilename", F.lit("a"))
    newer = older.withColumn("zipfilename", F.lit("b")).withColumn("article_dc_title", F.lit("nieuw"))
    many = newer.where("identifier = '1'").crossJoin(spark.range(500).drop("id"))
    latest = corpus.latest_by_id(older.unionByName(newer.where("identifier < '3'")).unionByName(many))
    assert latest.count() == 60
    new = {r["identifier"] for r in latest.where("article_dc_title = 'nieuw'").collect()}
    assert new == {str(i) for i in range(60) if str(i) < "3"}


def test_bucketed_corpus_is_not_shuffled(spark, plan_of):
    from datetime import date as day

    from broadsheet.functions.clauses import term
    from broadsheet.plans import batch

    spark.sql("drop table if exists bucketed_articles")
    articles = some_articles(spark).withColumns(
        {"article_dc_subject": F.lit("artikel"), "paper_dcterms_spatial": F.lit("Landelijk")}
    )
    corpus.save_bucketed(articles, "bucketed_articles", 4)
    stored = spark.table("bucketed_articles")
    saved = [batch.SavedQuery(1, term("woord"), day(1850, 1, 1), day(1990, 1, 1))]
    compiled = batch.compile_queries(*batch.query_tables(spark, saved), batch.corpus_vocabulary(stored))
    matches = batch.saved_query_matches(stored, compiled)
    assert "Exchange hashpartitioning" not in plan_of(matches)
    assert matches.count() == 60
    spark.sql("drop table bucketed_articles")


def test_saved_queries_from_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        "id,query,date_lower,date_upper,exclude_article_type,exclude_distributions,user_id\n"
        "62.0,verslaafd*,1880-01-01,1990-12-31,,,11.0\n"
        '7.0,"""a b"" OR c",1900-01-01,1914-07-27,st_advert+st_illust,sd_surinam,5.0\n'
    )
    typed = saved_queries.read_saved_queries(spark, str(tmp_path / "q.csv"), "csv", escape='"')
    got = {r["id"]: r for r in typed.collect()}
    assert got[62]["exclude_article_type"] == [] and got[62]["date_upper"] == date(1990, 12, 31)
    assert got[7]["query"] == '"a b" OR c' and got[7]["exclude_article_type"] == ["st_advert", "st_illust"]
    assert saved_queries.in_random_order(typed, 1).count() == 2
    many = spark.range(500).select(F.col("id").cast("int"))
    orders = [[r["id"] for r in saved_queries.in_random_order(many.repartition(n), 3).collect()] for n in (1, 8)]
    assert orders[0] == orders[1] != sorted(orders[0])


def test_sinks(spark, tmp_path):
    counts = spark.createDataFrame([('"de"', 2), ("a\\b", 1)], "term string, count bigint")
    sinks.write_counts(counts, str(tmp_path / "tsv"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "tsv")).collect()} == {'"de"\t2', "a\\b\t1"}
    clouds = spark.createDataFrame([(1, "de", 2), (7, "a", 1), (7, "b", 3)], "query_id int, term string, count bigint")
    sinks.write_query_counts(clouds, str(tmp_path / "clouds"))
    lines = spark.read.text(str(tmp_path / "clouds" / "query_id=7")).collect()
    assert {r["value"] for r in lines} == {"a\t1", "b\t3"}
    log = spark.createDataFrame([("run@articles", 1, "ok", 5, 0.5)], "identifier string, queryid int, status string, count bigint, time double")
    for _ in range(2):
        sinks.append_results(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_running_counts_equal_a_batch(spark, tmp_path):
    from broadsheet.operators.counts import word_counts

    articles = some_articles(spark)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        articles.where(F.col("identifier").cast("int") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(articles.schema).parquet(source)
        running.start_running_counts(stream, out, state).awaitTermination()
    latest = running.latest_counts(spark.read.parquet(out))
    assert sorted(latest.collect()) == sorted(word_counts(articles).collect())


def test_running_cloud_over_batches_and_a_restart(spark, tmp_path):
    """After each batch the ranking is that of all articles so far, and the changes lead to it."""
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    texts = ["aa aa aa bb bb cc", "bb bb dd", "dd dd dd dd ee", "cc cc cc cc cc", "ff", "", "aa ee ee ee ee ee ee"]
    columns = "article_dc_title string, text_content string"
    for n, text in enumerate(texts):
        # Each file is a batch; the query starts again for every second one.
        spark.createDataFrame([("", text)], columns).coalesce(1).write.mode("append").parquet(inbox)
        if n % 2 or n == len(texts) - 1:
            stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(inbox)
            running.start_running_cloud(stream, out, state, k=3).awaitTermination()
    order = spark.read.parquet(f"{out}/ranking").select("batch").distinct().count()
    assert order == len(texts)
    place: dict[str, int] = {}
    for batch in range(len(texts)):
        counts: dict[str, int] = {}
        for word in " ".join(texts[: batch + 1]).split():
            counts[word] = counts.get(word, 0) + 1
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        expected = {word: (count, n + 1) for n, (word, count) in enumerate(best)}
        stored = spark.read.parquet(f"{out}/ranking/batch={batch}").collect()
        assert {r["term"]: (r["count"], r["rank"]) for r in stored} == expected
        for r in spark.read.parquet(f"{out}/changes/batch={batch}").collect():
            assert r["was"] == place.get(r["term"]) and r["rank"] != r["was"]
            if r["rank"] is None:
                del place[r["term"]]
            else:
                place[r["term"]] = r["rank"]
        assert place == {word: rank for word, (_, rank) in expected.items()}
    last = running.ranking(spark, out).collect()
    assert {r["term"]: (r["count"], r["rank"]) for r in last} == expected


def test_built_archives_grow_with_the_table(spark, tmp_path, monkeypatch):
    """One task reads a gzip file, so a larger table makes more of them, with the same rows (F8, F12, F13, F14)."""
    from broadsheet.suite import queries as suite

    rows = [(i, f"regel {i}. tekst\nmeer", "nl", "bron", 10) for i in range(1, 400)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    names = ("xml_ingest", "incremental_ingest", "xml_quarantine", "ingest_report")
    results, files = [], []
    for size in (32 << 20, 512):
        monkeypatch.setattr(suite, "_XML_BYTES", size)
        found = suite.queries()
        results.append([sorted(map(str, found[n](spark, str(tmp_path)).collect())) for n in names])
        files.append(spark.read.format("binaryFile").load(suite._write_xml(spark, str(tmp_path)) + "/part-*").count())
    assert results[0] == results[1]
    assert files[0] <= 8 < 12 < files[1]


def test_a_year_replaced_as_a_whole_is_not_read_again(spark, tmp_path, monkeypatch):
    """A load keeps rows only of years that it replaces in part, and stores its rows once before (F11)."""
    from datetime import date

    from broadsheet.sources import corpus

    columns = "identifier string, paper_dc_date date, text_content string, zipfilename string"
    made = lambda rows: spark.createDataFrame([(i, date(y, 1, 1) if y else None, t, None) for i, y, t in rows], columns)
    path, stored, texts, reads = str(tmp_path / "corpus"), corpus._stored, [], []

    def seen(df, keep=corpus.durable):
        texts.append("text_content" in df.columns)
        return keep(df)

    def read(spark, path, state, years=None):
        reads.append(years)
        return stored(spark, path, state, years)

    corpus.upsert(made([("a", 1900, "1"), ("b", 1900, "1"), ("c", 1901, "1"), ("d", 1901, "1"), ("e", None, "1"), ("f", 1903, "1")]), path)
    monkeypatch.setattr(corpus, "durable", seen)
    monkeypatch.setattr(corpus, "_stored", read)
    corpus.upsert(made([("a", 1900, "2"), ("b", 1902, "2"), ("c", 1901, "2"), ("e", None, "2"), ("e", None, "2")]), path)
    assert sum(texts) == 1
    assert [years for years in reads if years is not None] == [{"1901"}]
    found = {(r["identifier"], r["paper_dc_date"] and r["paper_dc_date"].year, r["text_content"]) for r in corpus.read_corpus(spark, path).collect()}
    assert found == {("a", 1900, "2"), ("b", 1902, "2"), ("c", 1901, "2"), ("d", 1901, "1"), ("e", None, "2"), ("f", 1903, "1")}
