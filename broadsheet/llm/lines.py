"""Lines that many documents share, kept in one document only. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import durable
from .common import lookup

_BLANKS = " \t\n\v\f\r"
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case, all else as it is."""
    bare = F.btrim(line, F.lit(_BLANKS))
    only_ascii = F.octet_length(bare) == F.length(bare)
    plain = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(only_ascii, F.lower(bare)).otherwise(plain)


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def shared_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """``id, text_hash, lost``: the positions of the lines that each document loses.

    Lines become (id, position, 128-bit hash of the key) and are stored once; texts do not
    move. The number of distinct ids of a key is combined before it is shuffled, and keys of
    many lines are looked up by broadcast (see ``common.lookup``).
    """
    named = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64(_whole(text)).alias("text_hash"),
        F.split(_whole(text), "\n").alias("lines"),
    )
    cut = named.select("id", "text_hash", F.posexplode("lines").alias("at", "line"))
    keyed = once(cut, {"key": line_key(F.col("line"))})
    hashed = keyed.where(F.length("key") >= min_chars).select(
        "id", "text_hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2")
    )
    lines = durable(hashed)
    keys = ["h1", "h2"]
    common = durable(
        lines.groupBy(*keys)
        .agg(
            F.countDistinct("id").alias("docs"),
            F.max("id").alias("keeper"),
            F.count(F.lit(1)).alias("rows"),
        )
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    found = lookup(lines, common, keys, "rows", lines.count(), "inner")
    return (
        found.where(F.col("id") != F.col("keeper"))
        .groupBy("id", "text_hash")
        .agg(F.collect_set("at").alias("lost"))
    )


def drop_shared_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """``doc`` (the row as it was), ``kept`` (its text without shared lines), ``n_lines``, ``n_dropped``.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold
    loses all its lines except in the largest id that holds it. A document is a doc_id: rows
    that repeat an id count once, and a null id counts as one document with the smallest id.
    A null or empty text is one empty line. Each row keeps its own lines, joined by newlines;
    a document may lose all of them. An empty table gives no rows.
    """
    lost = shared_lines(docs, doc_id, text, min_chars, min_docs)
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64(_whole(text)).alias("text_hash"),
    )
    whole = F.coalesce(F.col("doc")[text], F.lit(""))
    joined = once(rows.join(lost, ["id", "text_hash"], "left"), {"lines": F.split(whole, "\n")})
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.array_join(F.transform(places, lambda at: F.get("lines", at)), "\n")
    return joined.select(
        "doc",
        F.when(F.col("lost").isNull(), whole).otherwise(kept).alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
