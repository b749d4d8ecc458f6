"""Scalar helpers for ingest and saved queries, all evaluated inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(values: Column) -> Column:
    """First element of a multi-valued field; null when there is none."""
    return F.get(values, F.lit(0))


def paragraph_join(paragraphs: Column) -> Column:
    """Non-empty paragraphs with a blank line between them; no text gives ''."""
    kept = F.filter(paragraphs, lambda p: p.isNotNull() & (p != ""))
    return F.coalesce(F.array_join(kept, "\n\n"), F.lit(""))


def escape_ampersands(markup: Column) -> Column:
    return F.replace(markup, F.lit("&"), F.lit("&amp;"))


def escape_markup(markup: Column) -> Column:
    """Markup in which every ``&`` is text, and CDATA sections are written as escaped text.

    What stands in a section comes out of ``html_unescape`` as it was; its ``<`` begins no
    element. A section that does not end is left, so the markup stays malformed.
    """

    def section(part: Column, at: Column) -> Column:
        inside = F.substring_index(part, "]]>", 1)
        text = F.replace(F.replace(inside, F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&amp;lt;"))
        after = escape_ampersands(F.substr(part, F.length(inside) + 4))
        open_ = F.concat(F.lit("<![CDATA["), escape_ampersands(part))
        return (
            F.when(at == 0, escape_ampersands(part))
            .when(part.contains("]]>"), F.concat(text, after))
            .otherwise(open_)
        )

    parts = F.transform(F.split(markup, r"<!\[CDATA\["), section)
    return F.when(markup.contains("<![CDATA["), F.array_join(parts, "")).otherwise(
        escape_ampersands(markup)
    )


_REFERENCE = r"^(#[xX][0-9a-fA-F]+|#[0-9]+|\w{1,8});"


def _code_point(code: Column) -> Column:
    """The character with a decimal code; null outside Unicode."""
    number = code.try_cast("bigint")
    bytes_ = F.unhex(F.lpad(F.hex(number), 8, "0"))
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(bytes_, "UTF-32"))


def html_unescape(text: Column) -> Column:
    """Replace character references that end in a semicolon; others stay as they are.

    The names are those of HTML 4 and ``apos``. Each reference is replaced once, so
    ``&amp;lt;`` becomes ``&lt;``.
    """
    names = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'"}
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])

    def piece(part: Column, at: Column) -> Column:
        name = F.regexp_extract(part, _REFERENCE, 1)
        hexa = F.conv(F.regexp_extract(name, "^#[xX](.+)$", 1), 16, 10)
        deci = F.regexp_extract(name, "^#([0-9]+)$", 1)
        value = (
            F.when(F.lower(name).startswith("#x"), _code_point(hexa))
            .when(name.startswith("#"), _code_point(deci))
            .otherwise(F.try_element_at(table, name))
        )
        rest = F.substr(part, F.length(name) + 2)
        whole = F.concat(F.lit("&"), part)
        swapped = F.coalesce(F.concat(value, rest), whole)
        return F.when(at == 0, part).when(name == "", whole).otherwise(swapped)

    pieces = F.transform(F.split(text, "&"), piece)
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def bulk_file_name(path: Column) -> Column:
    return F.concat(file_stem(path), F.lit(".json.gz"))


def split_list(codes: Column) -> Column:
    """Items of a list written with ``+``; an empty text is an empty list."""
    return F.filter(F.split(F.coalesce(codes, F.lit("")), r"\+"), lambda c: c != "")


def parse_date(text: Column) -> Column:
    """A date with an optional time part; anything else is null."""
    return F.split_part(text, F.lit("T"), F.lit(1)).try_cast("date")


def run_label(run: Column, index: Column) -> Column:
    return F.concat_ws("@", run, index)
