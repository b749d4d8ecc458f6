"""The saved-query table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_date, split_list
from ..schema import code_dictionary


def typed(queries: DataFrame) -> DataFrame:
    """Stored text columns as ids, dates and code lists."""
    return queries.select(
        F.col("id").cast("double").cast("int").alias("id"),
        "query",
        parse_date(F.col("date_lower").cast("string")).alias("date_lower"),
        parse_date(F.col("date_upper").cast("string")).alias("date_upper"),
        split_list(F.col("exclude_article_type")).alias("exclude_article_type"),
        split_list(F.col("exclude_distributions")).alias("exclude_distributions"),
        F.col("user_id").cast("double").cast("int").alias("user_id"),
    )


def read_saved_queries(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Every saved query of a stored table; ``format`` is any Spark source, ``jdbc`` too."""
    if format == "csv":
        options = {"header": "true", **options}
    reader = spark.read.format(format).options(**options)
    return typed(reader.load(path) if path else reader.load())


def as_json(queries: DataFrame) -> DataFrame:
    """``(id, json)``: each query as one JSON document, to hand to another job."""
    return queries.select("id", F.to_json(F.struct(*queries.columns)).alias("json"))


def random_key(seed: int) -> Column:
    """A key of a query's id and the seed alone, so an order by it is the same on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))


def in_random_order(queries: DataFrame, seed: int) -> DataFrame:
    return queries.orderBy(random_key(seed), "id")


def decode_exclusions(queries: DataFrame) -> DataFrame:
    """``(id, kind, code, label)`` for each exclusion; the label of an unknown code is null."""
    lists = F.array(
        F.struct(F.lit("article_type").alias("kind"), F.col("exclude_article_type").alias("codes")),
        F.struct(F.lit("distribution").alias("kind"), F.col("exclude_distributions").alias("codes")),
    )
    codes = queries.select("id", F.inline(lists)).select("id", "kind", F.explode("codes").alias("code"))
    # The dictionary has nine rows.
    dictionary = F.broadcast(code_dictionary(queries.sparkSession))
    return codes.join(dictionary, ["kind", "code"], "left").select("id", "kind", "code", "label")


def with_labels(queries: DataFrame) -> DataFrame:
    """Code lists replaced by label lists. An unknown code stops the job."""
    decoded = decode_exclusions(queries)
    checked = F.when(F.col("label").isNotNull(), F.col("label")).otherwise(
        F.raise_error(F.concat(F.lit("unknown filter code: "), F.col("code")))
    )
    lists = decoded.withColumn("label", checked).groupBy("id").agg(
        F.collect_set(F.when(F.col("kind") == "article_type", F.col("label"))).alias("article_types"),
        F.collect_set(F.when(F.col("kind") == "distribution", F.col("label"))).alias("distributions"),
    )
    none = F.array().cast("array<string>")
    return queries.join(lists, "id", "left").select(
        F.col("id").alias("query_id"),
        "date_lower",
        "date_upper",
        F.coalesce("article_types", none).alias("article_types"),
        F.coalesce("distributions", none).alias("distributions"),
    )
