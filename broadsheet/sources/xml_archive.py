"""Gzip XML newspaper files to article rows.

A file is read as a stream of records that end in ``</doc>``; no file is held in memory as
a whole. The same expressions serve batch and streaming reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import once
from ..functions.text import escape_markup, html_unescape, paragraph_join, parse_date
from ..schema import ARTICLE_COLUMNS, ARTICLE_FIELDS, CONTENT, DATE, ID, PAPER_FIELDS

RECORD_END = "</doc>"
READ_OPTIONS = {"lineSep": RECORD_END, "ignoreCorruptFiles": "true"}

_MARKUP = (
    "field array<struct<_name:string,_VALUE:string,text:array<struct<p:array<string>>>>>, "
    "_corrupt_record string"
)
_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "ignoreSurroundingSpaces": "false",
}


#: Status of the row that says that a file has been read to its end.
COMPLETE = "complete"


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows ``(xml, complete, zipfilename)`` of the files under ``path``.

    There is a row for each document, and one with ``complete`` for each file that was read to the
    end tag of its root. Both come from the same read. A file that breaks off, is no gzip file,
    or could not be read further gives the documents before that, no row with ``complete``,
    and does not stop the others.
    """
    return records(spark.read.options(**READ_OPTIONS).text(path))


def records(lines: DataFrame) -> DataFrame:
    """Cut each record at the start of its document element, and find the end of the file.

    The last record of a whole file ends in a tag that its document (if it has one, which then
    is not closed) does not open. Every other record ends inside an element of its document.
    """
    body = F.regexp_extract("value", r"(?s)<doc(?=[\s>]).*", 0)
    closed = F.regexp_extract("value", r"</([^<>\s]+)\s*>\s*$", 1)
    cut = once(lines.select("value", F.col("_metadata.file_path").alias("zipfilename")), {"body": body, "closed": closed})
    opened = F.contains("body", F.concat(F.lit("<"), "closed", F.lit(">"))) | F.contains(
        "body", F.concat(F.lit("<"), "closed", F.lit(" "))
    )
    row = lambda xml, complete: F.struct(xml.alias("xml"), F.lit(complete).alias("complete"))
    none = F.array().cast("array<struct<xml:string,complete:boolean>>")
    found = F.concat(
        F.when(F.col("body") != "", F.array(row(F.concat("body", F.lit(RECORD_END)), False))).otherwise(none),
        F.when((F.col("closed") != "") & ~opened, F.array(row(F.lit(None).cast("string"), True))).otherwise(none),
    )
    return cut.select(F.inline(found), "zipfilename")


def _named(name: str, nth: int) -> Column:
    """The nth field of that name, or null."""
    return F.get(F.filter(F.col("doc.field"), lambda f: f["_name"] == name), F.lit(nth))


def _first_text(paragraph: Column) -> Column:
    """Text before a nested element, as the paragraph's own text."""
    return F.substring_index(paragraph, "<", 1)


def parse(docs: DataFrame) -> DataFrame:
    """Article rows plus ``status`` and, for a rejected document, its ``xml``.

    A document is rejected when it is not well-formed or when a required field is missing.
    Only that document is set aside, not its whole file. The row of a file that was read to its
    end has the status ``complete`` and only ``zipfilename`` besides.
    """
    tree = F.from_xml(escape_markup(F.col("xml")), F.lit(_MARKUP), _OPTIONS)
    parsed = once(docs, {"doc": tree})
    fields = {f"paper_{n}": _named(n, 0) for n in PAPER_FIELDS}
    fields |= {f"article_{n}": _named(n, at) for n, at in ARTICLE_FIELDS.items()}
    content = _named("content", 0)
    picked = {"content": content, **fields}
    found = once(parsed.withColumn("broken", F.col("doc._corrupt_record").isNotNull()), picked)
    missing = F.col("content").isNull()
    for name in fields:
        missing = missing | F.col(name).isNull()
    identifier = F.col("article_dcx_recordIdentifier")["_VALUE"]
    status = (
        F.when(F.col("complete"), COMPLETE)
        .when(F.col("broken"), "malformed")
        .when(missing, "missing_field")
        .when(identifier.isNull(), "missing_identifier")
        .otherwise("ok")
    )
    paragraphs = F.get(F.col("content")["text"], F.lit(0))["p"]
    text = html_unescape(paragraph_join(F.transform(paragraphs, _first_text)))
    values = {n: F.col(n)["_VALUE"] for n in fields}
    values[DATE] = parse_date(values[DATE])
    values |= {CONTENT: text, "zipfilename": F.col("zipfilename"), ID: identifier}
    judged = once(found, {"status": status})
    return judged.select(
        *[values[c].alias(c) for c in ARTICLE_COLUMNS],
        "status",
        F.when(~F.col("status").isin("ok", COMPLETE), F.col("xml")).alias("rejected_xml"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == "ok").select(*ARTICLE_COLUMNS)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected documents with the reason and their source."""
    bad = parsed.where(~F.col("status").isin("ok", COMPLETE))
    return bad.select("zipfilename", "status", "rejected_xml")


def completed_files(parsed: DataFrame) -> DataFrame:
    """``zipfilename`` of each file that the read behind ``parsed`` has read to its end."""
    return parsed.where(F.col("status") == COMPLETE).select("zipfilename").distinct()


def listed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``zipfilename`` of every file, written as in the articles. No content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("zipfilename"))


def pending_files(spark: SparkSession, path: str | list[str], parsed: DataFrame) -> DataFrame:
    """``zipfilename`` of the files that ``parsed`` has not read to their end: new and unfinished ones.

    Give it all rows of ``parse``, or the stored ones. A whole file without documents is done.
    """
    return listed_files(spark, path).join(completed_files(parsed), "zipfilename", "left_anti")


def unfinished_files(spark: SparkSession, path: str | list[str], parsed: DataFrame) -> DataFrame:
    """Quarantine rows, with status ``unreadable``, for the files not read to their end."""
    return pending_files(spark, path, parsed).select(
        "zipfilename", F.lit("unreadable").alias("status"), F.lit(None).cast("string").alias("rejected_xml")
    )


def ingest_report(spark: SparkSession, path: str | list[str], parsed: DataFrame | None = None) -> DataFrame:
    """``zipfilename, articles, rejected, status`` for every file, also those without an article.

    ``status`` is ``unreadable`` for a file that was not read to its end, ``empty`` for a whole
    one without any document, else ``ok``. It tells of the read behind ``parsed``; without that
    the files are read here, once.
    """
    if parsed is None:
        parsed = parse(read_records(spark, path))
    is_ = lambda *of: F.col("status").isin(*of)
    counted = parsed.groupBy("zipfilename").agg(
        F.count_if(is_("ok")).alias("articles"),
        F.count_if(~is_("ok", COMPLETE)).alias("rejected"),
        F.max(is_(COMPLETE)).alias("whole"),
    )
    none = F.lit(0).cast("bigint")
    found = listed_files(spark, path).join(counted, "zipfilename", "left")
    return found.select(
        "zipfilename",
        F.coalesce("articles", none).alias("articles"),
        F.coalesce("rejected", none).alias("rejected"),
        F.when(~F.coalesce("whole", F.lit(False)), "unreadable")
        .when(F.col("articles") + F.col("rejected") == 0, "empty")
        .otherwise("ok")
        .alias("status"),
    )
