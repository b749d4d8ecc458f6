"""Incremental ingest: each run converts only the files it has not read to their end."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import ARTICLE_COLUMNS
from ..session import durable
from ..sources.corpus import latest_by_id, with_year
from ..sources.xml_archive import (
    READ_OPTIONS,
    completed_files,
    parse,
    pending_files,
    quarantine,
    read_records,
    records,
)


def ingest_new_files(
    spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Parse new files and add their documents to ``out_dir``, by status and year.

    The checkpoint remembers the files that were seen, and the file sink publishes a batch
    as a whole. Accepted and rejected documents, and a row for each file read to its end, come
    out of one parse. A file without such a row was cut short; ``read_again`` takes it up.
    """
    lines = (
        spark.readStream.format("text")
        .options(**READ_OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(input_dir)
    )
    return (
        with_year(parse(records(lines)))
        .writeStream.format("parquet")
        .partitionBy("status", "year")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_again(spark: SparkSession, input_dir: str, out_dir: str, at_once: int = 1000) -> DataFrame:
    """Read the files again that no run has read to their end; ``zipfilename`` of those still unfinished.

    Run it after ``ingest_new_files``, not beside it. Up to ``at_once`` files are read in one job. Of
    a file that now comes to its end all documents are stored, and they replace what an earlier
    read had of it; one that does not stays as it is, and is read again the next time. What is
    stored shows at once, when the folder of this run gets its mark of success.
    """
    pending = pending_files(spark, input_dir, _all_rows(spark, out_dir)).orderBy("zipfilename").limit(at_once)
    paths = [unquote(r["zipfilename"]) for r in pending.collect()]
    if paths:
        parsed = durable(with_year(parse(read_records(spark, [_literal(p) for p in paths]))))
        whole = completed_files(parsed)
        if not whole.isEmpty():
            run = f"{_repairs(out_dir)}/run={len(_finished_repairs(spark, out_dir)):09d}"
            parsed.join(whole, "zipfilename", "left_semi").write.mode("overwrite").parquet(run)
    return pending_files(spark, input_dir, _all_rows(spark, out_dir))


def _literal(path: str) -> str:
    """A path whose characters mean themselves in a pattern of paths."""
    return "".join("\\" + c if c in "\\*?[]{}," else c for c in path)


def _repairs(out_dir: str) -> str:
    """A folder of its own: readers of a streaming sink see only what the stream wrote."""
    return f"{out_dir.rstrip('/')}.read-again"


def _finished_repairs(spark: SparkSession, out_dir: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_repairs(out_dir)}/run=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath().getParent()) for f in found or []]


def _all_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Stored rows; files that were read again only with the rows of that read."""
    stored = spark.read.parquet(out_dir)
    runs = _finished_repairs(spark, out_dir)
    if not runs:
        return stored
    again = spark.read.schema(stored.schema).parquet(*runs)
    return stored.join(completed_files(again), "zipfilename", "left_anti").unionByName(again)


def ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """Accepted articles, one row an id; the status folder prunes the rest."""
    stored = _all_rows(spark, out_dir).where(F.col("status") == "ok")
    return latest_by_id(stored.select(*ARTICLE_COLUMNS))


def converted_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """``zipfilename`` of every file that was read to its end, whether it gave documents or not."""
    return completed_files(_all_rows(spark, out_dir))


def rejected(spark: SparkSession, out_dir: str) -> DataFrame:
    return quarantine(_all_rows(spark, out_dir))


def unfinished(spark: SparkSession, input_dir: str, out_dir: str) -> DataFrame:
    """``zipfilename`` of the files that are new or that no run has read to their end."""
    return pending_files(spark, input_dir, _all_rows(spark, out_dir))
