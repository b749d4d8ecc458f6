from datetime import date

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text as X
from broadsheet.functions import tokens as K


@pytest.fixture
def value(spark):
    def one(make, *args, schema="a string"):
        df = spark.createDataFrame([args], schema)
        return df.select(make(*[F.col(c) for c in df.columns]).alias("v")).first()["v"]

    return one


def test_raw_tokens_keep_case_and_punctuation(value):
    assert value(K.raw_tokens, " De\tkat,\n\r\fZAT  op\x0bmat ") == ["De", "kat,", "ZAT", "op\x0bmat"]
    assert value(K.raw_tokens, "") == []
    assert value(K.raw_tokens, None) is None


def test_stripped_tokens(value):
    every = "a" + "b".join(K.PUNCTUATION) + "c"
    assert value(K.stripped_tokens, every) == ["a"] + ["b"] * 23 + ["c"]
    assert value(lambda c: K.stripped_tokens(c, 2), "'t Is O.K. don't é") == ["is", "don"]
    assert len(K.PUNCTUATION) == len(set(K.PUNCTUATION)) == 24


def test_analyzed_tokens(value):
    text = "De U.S.A. en Jan's 3.5 a.1 foo_bar ___ coca-cola 1,000,5 ’s niet"
    assert value(K.analyzed_tokens, text) == [
        "u.s.a", "jan's", "3.5", "a", "1", "foo_bar", "coca", "cola", "1,000,5", "s",
    ]
    assert value(K.analyzed_tokens, "film film") == ["film", "film"]


def test_positions_keep_places_of_stop_words(value):
    assert value(K.analyzed_positions, "gast van de regering") == ["gast", "", "", "regering"]
    assert K.analyze_query("gast van de regering") == ["gast", "", "", "regering"]


def test_very_long_words_do_not_overflow_the_stack(value):
    assert value(K.analyzed_tokens, "x" * 200_000 + " " + "a.b" * 50_000 + " " + "_" * 50_000) is not None


@pytest.mark.parametrize("text", ["De U.S.A. en Jan's 3.5", "new-york", 'a "modern*" b?c', "cocaïne"])
def test_query_words_are_cut_as_texts_are(value, text):
    assert value(K.analyzed_positions, text) == K.analyze_query(text)


def test_stop_list_is_the_one_spark_ships(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert sorted(StopWordsRemover.loadDefaultStopWords("dutch")) == sorted(K.DUTCH_STOP_WORDS)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a &amp; b &lt;p&gt; &eacute;", "a & b <p> é"),
        ("&amp;lt;", "&lt;"),
        ("&#233;&#xe9;&#XE9;&#128512;", "ééé😀"),
        ("&apos;&quot;", "'\""),
        ("&unknown; &amp & &; &#; &#x;", "&unknown; &amp & &; &#; &#x;"),
        ("&#99999999;", "&#99999999;"),
        ("no entity", "no entity"),
        ("", ""),
        (None, None),
    ],
)
def test_html_unescape(value, text, expected):
    assert value(X.html_unescape, text) == expected


def test_paragraphs(value):
    assert value(X.paragraph_join, ["een", "", None, "twee"], schema="a array<string>") == "een\n\ntwee"
    assert value(X.paragraph_join, None, schema="a array<string>") == ""


@pytest.mark.parametrize(
    ("path", "stem"),
    [("in/a.xml.gz", "a.xml"), ("a.gz", "a"), ("in/noext", "noext"), ("in/.gz", ".gz"), ("x.y/b", "b")],
)
def test_file_stem(value, path, stem):
    assert value(X.file_stem, path) == stem
    assert value(X.bulk_file_name, path) == stem + ".json.gz"


def test_lists_and_labels(value):
    assert value(X.split_list, "a+b") == ["a", "b"]
    assert value(X.split_list, "") == []
    assert value(X.split_list, None) == []
    assert value(X.run_label, "run", "kb", schema="a string, b string") == "run@kb"


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("1950-01-02", date(1950, 1, 2)),
        ("1950-01-02T10:00:00Z", date(1950, 1, 2)),
        ("1950", date(1950, 1, 1)),
        ("omstreeks 1950", None),
        (None, None),
    ],
)
def test_parse_date(value, text, day):
    assert value(X.parse_date, text) == day
