"""Running word counts and a running word cloud over a stream of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counts import top_terms, word_counts

RANKING = "term string, count bigint, rank bigint"


def start_running_counts(articles: DataFrame, path: str, checkpoint: str, **tokens) -> StreamingQuery:
    """Keep a count per word and store the words that changed in each micro-batch.

    The state is spread over the cluster by word. A batch that is tried again overwrites
    its own folder.
    """

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        word_counts(articles, **tokens)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(changes: DataFrame) -> DataFrame:
    """``(term, count)`` after the last batch, from the stored changes."""
    return changes.groupBy("term").agg(F.max_by("count", "batch").alias("count"))


def start_running_cloud(articles: DataFrame, path: str, checkpoint: str, k: int = 100, **tokens) -> StreamingQuery:
    """Keep the ``k`` most frequent words of a stream; store the ranking and its changes.

    Each micro-batch writes ``ranking/batch=n`` (``term, count, rank``: at most ``k`` rows) and
    ``changes/batch=n`` (``term, count, rank, was``) with the words that came in, went out or
    have another place: ``was`` or ``rank`` is null for a word outside. Equal counts are ordered by word.

    The state is a count per word, spread over the cluster by word. Counts only grow, so a word that
    a batch leaves alone does not rise, and a changed one beyond the best ``k`` of the changed has
    ``k`` words before it: the new ranking is among the old one and the best of the changed. So
    the changed words are read once, and 2 ``k`` rows are ranked. A batch that is tried again
    starts from the ranking of the one before it, which is complete, and overwrites its own folders.
    """

    def store(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        before = _ranking_of(spark, path, batch - 1)
        either = top_terms(changed, k).select("term", "count").unionByName(before.select("term", "count"))
        _ranked(either.groupBy("term").agg(F.max("count").alias("count")), k).write.mode("overwrite").parquet(
            _folder(path, batch)
        )
        after = _ranking_of(spark, path, batch)
        was = before.select("term", F.col("count").alias("old"), F.col("rank").alias("was"))
        moved = after.join(was, "term", "full").where(~F.col("rank").eqNullSafe(F.col("was")))
        moved.select("term", F.coalesce("count", "old").alias("count"), "rank", "was").write.mode(
            "overwrite"
        ).parquet(f"{path}/changes/batch={batch}")

    return (
        word_counts(articles, **tokens)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _folder(path: str, batch: int) -> str:
    return f"{path}/ranking/batch={batch}"


def _ranking_of(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The ranking after a batch; nothing before the first."""
    if batch < 0:
        return spark.createDataFrame([], RANKING)
    return spark.read.schema(RANKING).parquet(_folder(path, batch))


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` with their places; the window sees ``k`` rows."""
    order = Window.orderBy(F.desc("count"), "term")
    return top_terms(counts, k).withColumn("rank", F.row_number().over(order).cast("bigint"))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """``term, count, rank`` after the last stored batch; there must be one."""
    stored = spark.read.schema(f"{RANKING}, batch bigint").parquet(f"{path}/ranking")
    last = stored.agg(F.max("batch")).first()[0]
    return stored.where(F.col("batch") == F.lit(last)).drop("batch")
