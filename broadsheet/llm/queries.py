"""One query an operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    ann,
    audit,
    byte_bpe,
    language,
    lines,
    packing,
    piece_counts,
    quality,
    shards,
    simhash,
    topk,
    toxicity,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = byte_bpe.encoded(spark, F.col("text"), path, public_tokenizers.PATTERN)
    docs = table(spark, sf, "documents").select("doc_id", made.alias("made"))
    return docs.select("doc_id", "made.*")


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.drop_shared_lines(docs).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op5_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.shard(table(spark, sf, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = piece_counts.token_counts(spark, text, public_tokenizers.path("piece_bpe_32k.model"))
    counted = table(spark, sf, "documents").select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), tokens.alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    digits = simhash.hexadecimal(F.col("fingerprint"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.predicted(docs, language.fit(docs))
    return docs.select("doc_id", language.held_out().alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    scored = docs.select(
        "doc_id", language.held_out().alias("held_out"), toxicity.score(docs, model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op6_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), k=20, every=20)


@query
def op10_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), k=10, every=100)


@query
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(table(spark, sf, "documents"), least_docs=10, top=10)


@query
def op12_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align(table(spark, sf, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
