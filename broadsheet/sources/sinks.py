"""Output of word counts and of the result log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RESULT_LOG_SCHEMA


def write_counts(counts: DataFrame, path: str) -> None:
    """Tab-separated lines of word and count, with nothing quoted."""
    line = F.concat_ws("\t", "term", F.col("count").cast("string"))
    counts.select(line.alias("value")).write.text(path)


def write_query_counts(counts: DataFrame, path: str) -> None:
    """One folder a saved query, with its tab-separated lines of word and count.

    The rebalance hint puts a query into few files and cuts one that holds many rows.
    """
    line = F.concat_ws("\t", "term", F.col("count").cast("string"))
    rows = counts.select("query_id", line.alias("value")).hint("rebalance", "query_id")
    rows.write.partitionBy("query_id").text(path)


def append_results(results: DataFrame, path: str) -> None:
    """Add rows to the result log, which is created when it is not there yet."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_LOG_SCHEMA]
    results.select(*columns).write.mode("append").parquet(path)
