"""Schemas, code dictionaries and the article view over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITLE = "article_dc_title"
PAPER = "paper_dc_title"
CONTENT = "text_content"
DATE = "paper_dc_date"
SUBJECT = "article_dc_subject"
SPATIAL = "paper_dcterms_spatial"
ID = "identifier"

# Fields of the free-text search, and fields of a word cloud.
SEARCH_FIELDS = (TITLE, PAPER, CONTENT)
CLOUD_FIELDS = (CONTENT, TITLE)

# The two scopes of a text clause and the fields that they read.
ALL = "all"
TITLE_ONLY = "title"
SEARCH_TEXT = {ALL: SEARCH_FIELDS, TITLE_ONLY: (TITLE,)}
# Columns of a corpus that keeps its words next to its texts.
STORED_WORDS = {ALL: "all_words", TITLE_ONLY: "title_words"}

# Names in the input markup. A paper field is the first occurrence of its
# name in a document; an article field gives the name and which occurrence it is.
PAPER_FIELDS = (
    "dc_title",
    "dc_identifier",
    "dcterms_alternative",
    "dcterms_isVersionOf",
    "dc_date",
    "dcterms_temporal",
    "dcx_recordRights",
    "dc_publisher",
    "dcterms_spatial",
    "dc_source",
    "dcx_volume",
    "dcx_issuenumber",
    "dcx_recordIdentifier",
    "dc_identifier_resolver",
    "dc_language",
    "dcterms_isPartOf",
    "ddd_yearsDigitized",
    "dcterms_spatial_creation",
    "dcterms_issued",
)
ARTICLE_FIELDS = {
    "dc_subject": 0,
    "dc_title": 1,
    "dcterms_accessRights": 0,
    "dcx_recordIdentifier": 1,
    "dc_identifier_resolver": 1,
}

# Filter codes and the labels they stand for.
DISTRIBUTION_LABELS = {
    "sd_national": "Landelijk",
    "sd_regional": "Regionaal/lokaal",
    "sd_antilles": "Nederlandse Antillen",
    "sd_surinam": "Suriname",
    "sd_indonesia": "Nederlands-Indië / Indonesië",
}
ARTICLE_TYPE_LABELS = {
    "st_article": "artikel",
    "st_advert": "advertentie",
    "st_illust": "illustratie met onderschrift",
    "st_family": "familiebericht",
}

ARTICLE_COLUMNS = (
    tuple(f"paper_{name}" for name in PAPER_FIELDS)
    + tuple(f"article_{name}" for name in ARTICLE_FIELDS)
    + (CONTENT, "zipfilename", ID)
)

ARTICLE_SCHEMA = T.StructType(
    [T.StructField(c, T.DateType() if c == DATE else T.StringType()) for c in ARTICLE_COLUMNS]
)

RESULT_LOG_SCHEMA = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("queryid", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("time", T.DoubleType()),
    ]
)


def code_dictionary(spark: SparkSession) -> DataFrame:
    """The filter codes as rows ``(kind, code, label)``."""
    rows = [("distribution", c, v) for c, v in DISTRIBUTION_LABELS.items()]
    rows += [("article_type", c, v) for c, v in ARTICLE_TYPE_LABELS.items()]
    return spark.createDataFrame(rows, "kind string, code string, label string")


def labels_for(codes: list[str], dictionary: dict[str, str]) -> list[str]:
    """Labels of ``codes``; an unknown code is an error."""
    unknown = [c for c in codes if c not in dictionary]
    if unknown:
        raise ValueError(f"unknown filter code: {', '.join(unknown)}")
    return [dictionary[c] for c in codes]


def _cycle(key: Column, labels: list[str], missing_every: int) -> Column:
    picked = F.element_at(
        F.array(*[F.lit(v) for v in labels]), (key % len(labels) + 1).cast("int")
    )
    return F.when(key % missing_every != 0, picked)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """The article view over the ``documents`` table (dates and labels follow the key)."""
    key = F.col("doc_id")
    return documents.select(
        key.cast("string").alias(ID),
        F.split_part(F.col("text"), F.lit("."), F.lit(1)).alias(TITLE),
        F.col("source").alias(PAPER),
        F.col("text").alias(CONTENT),
        F.date_add(F.lit("1850-01-01").cast("date"), (key * 7919 % 51499).cast("int")).alias(DATE),
        _cycle(key, list(ARTICLE_TYPE_LABELS.values()), 11).alias(SUBJECT),
        _cycle(key, list(DISTRIBUTION_LABELS.values()), 13).alias(SPATIAL),
    )
