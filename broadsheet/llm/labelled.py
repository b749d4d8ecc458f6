"""A bounded sample of labelled texts, for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable


def marked(labels: DataFrame, label: str, learn: Column, doc_id: str = "doc_id") -> DataFrame:
    """``(id, y)``: one row for each id to learn from; of several labels the largest counts.

    ``learn`` is a condition on the column ``id``. Null ids and labels other than 0 and 1 are left out.
    """
    y = F.col(label).cast("int")
    return (
        labels.select(F.col(doc_id).cast("bigint").alias("id"), y.alias("y"))
        .where(F.col("id").isNotNull() & learn & F.col("y").isin(0, 1))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )


def sample(
    docs: DataFrame, marks: DataFrame, features: Column, sample_rows: int, doc_id: str = "doc_id"
) -> tuple[DataFrame, dict[int, float]]:
    """``(id, y, chance, row)`` for about ``sample_rows`` labelled rows, and the share drawn of each label.

    Half of the rows have each label; they are drawn by a hash of the id, which gives ``chance``.
    ``features`` is a column over ``text``. The rows are stored; twice ``sample_rows`` bounds them.
    """
    counts = {y: n for y, n in marks.groupBy("y").count().collect()}
    part = {y: min(1.0, sample_rows / 2 / n) for y, n in counts.items()}
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / float(1 << 31)
    share = F.when(F.col("y") == 1, F.lit(part.get(1, 0.0))).otherwise(F.lit(part.get(0, 0.0)))
    drawn = marks.withColumn("chance", chance).where(F.col("chance") < share).limit(2 * sample_rows)
    rows = (
        docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col("text"))
        .join(F.broadcast(drawn), "id")
        .select("id", "y", "chance", features.alias("row"))
        .limit(2 * sample_rows)
    )
    return durable(rows), part
