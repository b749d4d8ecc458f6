"""A corpus pipeline: each stage works on what the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame with the columns of ``docs``, the last
one the packed pieces. Between stages the frame is written as Parquet and read again, so every
stage has a stored input and a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from broadsheet.llm import language, lines, packing, simhash, toxicity  # noqa: E402
from broadsheet.llm.common import table  # noqa: E402
from broadsheet.session import durable  # noqa: E402

#: Language ID rejects a text without letters, one that is not familiar from training, and one
#: for which the best one-versus-rest output is this far on the side of "rest" (the score is
#: (output + 1) / 2). The outputs of L languages sum to 2 - L, so the score is at least 1 / L:
#: alone it rejects nothing where there are four languages or fewer.
LEAST_LANGUAGE_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text is in some language."""
    model = language.fit(docs)
    found = language.predicted(docs, model)
    kept = (
        (F.col("found.lang_pred") != language.UNKNOWN)
        & (F.col("found.score") >= LEAST_LANGUAGE_SCORE)
        & (F.col("found.known") >= model.familiar)
    )
    return docs.select(F.struct("*").alias("doc"), found.alias("found")).where(kept).select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity model does not call toxic."""
    score = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.select(F.struct("*").alias("doc"), score.alias("toxic")).where(F.col("toxic") < 0.5).select("doc.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by its lines that are not kept in another document.

    A document that loses all its lines stays, with an empty text; ``n_chars``, if there is
    such a column, follows the text.
    """
    changed = F.col("n_dropped") > 0
    rows = lines.drop_shared_lines(docs)
    own = {c: F.col("doc")[c] for c in docs.columns}
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return rows.select(
        *[
            F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(was).alias(c)
            if c in new
            else was.alias(c)
            for c, was in own.items()
        ]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the group's smallest id.

    Of rows that repeat this id, those with the smallest hash of their text count, and one of
    them stays. Of rows with a null id one stays for each group without an id.
    """
    groups = simhash.near_duplicates(docs)
    alone = F.when(F.col("component_id").isNull(), F.col("group"))
    keepers = (
        groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy(F.col("component_id").alias("id"), alone.alias("alone"))
        .agg(F.min("text_hash").alias("text_hash"))
        .select("id", "text_hash")
    )
    rows = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").alias("own"), simhash.text_hash("text").alias("hash")
    )
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))
    return rows.join(keepers, same, "left_semi").dropDuplicates(["own", "hash"]).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in as few sequences as best fit finds."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: Kernels, factorization machines, XXH64 and tokenizers are not for SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
