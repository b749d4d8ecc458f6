"""Bulk NDJSON: pairs of an action line and a document line, gzip compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_date
from ..schema import ARTICLE_COLUMNS, DATE, ID

_LINE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ARTICLE_COLUMNS])


# What an action line may ask for.
_ACTIONS = ("index", "create", "update", "delete")


def read_bulk(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Articles of bulk files. A document repeats its id, so action lines are just dropped.

    Lines that cannot be read are dropped too; ``bulk_quarantine`` has them.
    """
    lines = spark.read.schema(_LINE_SCHEMA).json(path)
    return lines.where(F.col(ID).isNotNull()).withColumn(DATE, parse_date(F.col(DATE)))


def bulk_quarantine(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``filename, line`` of what is neither an action nor a document with an id."""
    schema = T.StructType(
        [T.StructField(ID, T.StringType()), T.StructField("_corrupt_record", T.StringType())]
        + [T.StructField(a, T.MapType(T.StringType(), T.StringType())) for a in _ACTIONS]
    )
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    read = lines.select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("line"), row.alias("row"))
    action = F.coalesce(*[F.col("row")[a] for a in _ACTIONS]).isNotNull()
    usable = F.col("row._corrupt_record").isNull() & (action | F.col("row")[ID].isNotNull())
    return read.where(~F.coalesce(usable, F.lit(False))).select("filename", "line")


def bulk_lines(articles: DataFrame) -> DataFrame:
    """``value``: the action line and the document line of each article."""
    action = F.to_json(F.struct(F.struct(F.col(ID).alias("_id")).alias("index")))
    columns = [c for c in ARTICLE_COLUMNS if c in articles.columns]
    document = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return articles.select(F.concat_ws("\n", action, document).alias("value"))


def write_bulk(articles: DataFrame, path: str) -> None:
    bulk_lines(articles).write.option("compression", "gzip").text(path)
