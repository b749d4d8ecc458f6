"""The article table: Parquet folders by load and year, made visible by a pointer.

A load writes year folders of its own, ``load=<id>/year=<year>``, which nobody reads yet. Then one
small file is renamed into ``_pointers``: the newest pointer names the folders that hold each year.
So a load, a replacement or a compaction is there as a whole or not at all, also after a
crash, and a reader that has begun keeps the folders it started from. Two loads at once are no
harm either: the second one finds its pointer's name taken and stops.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..schema import DATE, ID
from ..session import durable
from .bulk_json import read_bulk


def latest_by_id(articles: DataFrame) -> DataFrame:
    """One row for each id; the row of the last source file wins.

    Meant for a stored table: one pass over the ids finds those that repeat, and only their
    rows are shuffled. They are combined before the shuffle, so many copies of one id are
    no hot key.
    """
    seen = articles.groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
    repeated = durable(seen.where(F.col("n") > 1).select(ID))
    columns = [c for c in articles.columns if c != ID]
    order = F.struct(F.coalesce("zipfilename", F.lit("")), F.xxhash64(*columns))
    copies = articles.join(repeated, ID, "left_semi").groupBy(ID)
    last = copies.agg(F.max_by(F.struct(*columns), order).alias("row")).select(ID, "row.*")
    return articles.join(repeated, ID, "left_anti").unionByName(last)


def with_year(articles: DataFrame) -> DataFrame:
    return articles.withColumn("year", F.year(DATE))


@dataclass
class State:
    """What a pointer says: its number, the columns, and the load folders of each year."""

    number: int = 0
    schema: StructType = field(default_factory=StructType)
    years: dict[str, list[str]] = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str):
    """A path, its file system, and the classes of ``org.apache.hadoop.fs``."""
    names = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = names.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), names


def current(spark: SparkSession, path: str) -> State:
    """The state that the newest pointer names; an empty one where nothing has been published."""
    folder, files, names = _hadoop(spark, f"{path}/_pointers")
    if not files.exists(folder):
        return State()
    found = [status.getPath().getName() for status in files.listStatus(folder)]
    numbers = [int(name[:-5]) for name in found if name.endswith(".json")]
    if not numbers:
        return State()
    stream = files.open(names.Path(folder, f"{max(numbers):010d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    stored = json.loads(text)
    return State(max(numbers), StructType.fromJson(stored["schema"]), stored["years"])


def _publish(spark: SparkSession, path: str, before: State, schema: StructType, years: dict[str, list[str]]) -> None:
    """Rename a pointer into place. It must be the next one after ``before``."""
    folder, files, names = _hadoop(spark, f"{path}/_pointers")
    known = {f.name: f.dataType for f in before.schema}
    for new in schema:
        if known.setdefault(new.name, new.dataType) != new.dataType:
            raise ValueError(f"column {new.name} is stored with another type")
    columns = StructType([StructField(name, kind) for name, kind in known.items()])
    text = json.dumps({"schema": columns.jsonValue(), "years": years})
    files.mkdirs(folder)
    draft = names.Path(folder, f"{uuid.uuid4().hex}.draft")
    stream = files.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = names.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(names, "Options$Rename"), 0)
    context.rename(
        context.makeQualified(draft), context.makeQualified(names.Path(folder, f"{before.number + 1:010d}.json")), no_options
    )


def _write_load(rows: DataFrame, path: str) -> dict[str, list[str]]:
    """Write rows with their ``year`` as a load that no pointer names yet; its folders by year."""
    load = f"load=v{uuid.uuid4().hex}"
    rows.write.partitionBy("year").parquet(f"{path}/{load}")
    folder, files, _ = _hadoop(rows.sparkSession, f"{path}/{load}")
    found = [status.getPath().getName() for status in files.listStatus(folder)]  # a folder a year
    return {name[len("year="):]: [load] for name in found if name.startswith("year=")}


def _columns(rows: DataFrame) -> StructType:
    return StructType([f for f in rows.schema if f.name != "year"])


def _folder_of(year: int | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if year is None else str(year)


def _stored(spark: SparkSession, path: str, state: State, years: set[str] | None = None) -> DataFrame:
    """The stored rows with their ``year``, of all years or of some."""
    schema = StructType([*state.schema, StructField("year", IntegerType()), StructField("load", StringType())])
    folders = [
        f"{path}/{load}/year={year}"
        for year, loads in state.years.items()
        if years is None or year in years
        for load in loads
    ]
    if not folders:
        return spark.createDataFrame([], schema).drop("load")
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("load")


def write_corpus(articles: DataFrame, path: str, mode: str = "append") -> None:
    """Store articles by year: beside what is there, or with ``overwrite`` in its place.

    The rebalance hint sizes the output files: it merges small years and cuts a year that
    holds a large share of all rows.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("the mode is append or overwrite")
    spark, rows = articles.sparkSession, with_year(articles)
    before = current(spark, path)
    added = _write_load(rows.hint("rebalance", "year"), path)
    old = before.years if mode == "append" else {}
    years = {year: old.get(year, []) + added.get(year, []) for year in [*old, *added]}
    _publish(spark, path, before, _columns(rows), years)


def load_bulk(spark: SparkSession, bulk: str | list[str], path: str) -> None:
    """Load the articles of bulk NDJSON files: new ids are added, known ones replaced."""
    upsert(read_bulk(spark, bulk), path)


def upsert(articles: DataFrame, path: str) -> None:
    """Add articles to a corpus so that every id has one row, the one that was loaded last.

    Only the years that hold a loaded id, before or after, are written again, each as a
    whole. All of it becomes visible in one step; until then, and if the job dies,
    readers see the corpus as it was.
    """
    spark = articles.sparkSession
    new = latest_by_id(durable(with_year(articles)))
    before, ids = current(spark, path), new.select(ID)
    touched: set[str] = set()
    partly: set[str] = set()
    if before.years:
        found = _stored(spark, path, before).select(ID, "year").join(ids.withColumn("again", F.lit(1)), ID, "left")
        years = found.groupBy("year").agg(F.count("again").alias("again"), F.count(F.lit(1)).alias("all")).collect()  # a row a year
        added = {_folder_of(r["year"]) for r in new.select("year").distinct().collect()}
        touched = added | {_folder_of(r["year"]) for r in years if r["again"]}
        # A year whose rows are all replaced has none to keep: its texts are neither read nor shuffled.
        partly = {_folder_of(r["year"]) for r in years if r["again"] < r["all"]} & touched
    kept = _stored(spark, path, before, partly).join(ids, ID, "left_anti") if partly else None
    rows = kept.unionByName(new, allowMissingColumns=True) if partly else new
    added = _write_load(rows.hint("rebalance", "year"), path)
    years = {year: loads for year, loads in before.years.items() if year not in touched} | added
    _publish(spark, path, before, _columns(new), years)


def read_corpus(spark: SparkSession, path: str, date_lower=None, date_upper=None) -> DataFrame:
    """Stored articles; a date range also prunes the year folders."""
    state = current(spark, path)
    if not state.number:
        raise FileNotFoundError(f"no corpus has been published in {path}")
    articles = _stored(spark, path, state)
    for bound, inside in ((date_lower, "__ge__"), (date_upper, "__le__")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            articles = articles.where(getattr(F.col("year"), inside)(F.year(day)))
            articles = articles.where(getattr(F.col(DATE), inside)(day))
    return articles.drop("year")


def save_bucketed(articles: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store articles as a table bucketed by id, in the warehouse or under ``path``.

    The saved-query batch groups and joins by id: over this table it shuffles no article. With
    the words stored too (``filters.with_words``) it cuts no text either.
    """
    writer = articles.repartition(buckets, ID).write.bucketBy(buckets, ID).sortBy(ID)
    if path is not None:
        writer = writer.option("path", path)
    writer.mode("overwrite").saveAsTable(table)


def compact_corpus(spark: SparkSession, path: str, target: str | None = None, files: int | None = None) -> None:
    """Rewrite a corpus with few files for each year, in place or as a corpus of its own.

    ``files`` fixes the number of files for each year; without it the rebalance hint sizes
    them. The old folders stay as they are, so readers are not disturbed; ``remove_unused``
    deletes them.
    """
    before = current(spark, path)
    articles = _stored(spark, path, before)
    if files is None:
        arranged = articles.hint("rebalance", "year")
    else:
        part = F.pmod(F.xxhash64(ID), F.lit(files))
        arranged = articles.repartition(max(len(before.years) * files, 1), "year", part)
    target = target or path
    old = before if target == path else current(spark, target)
    _publish(spark, target, old, before.schema, _write_load(arranged, target))


def remove_unused(spark: SparkSession, path: str) -> int:
    """Delete loads that the newest pointer does not name, and older pointers; how many loads.

    For a time when nothing is being loaded and no reader of an older state is left.
    """
    state = current(spark, path)
    used = {load for loads in state.years.values() for load in loads}
    folder, files, names = _hadoop(spark, path)
    loads = [status.getPath() for status in files.listStatus(folder)]
    gone = [at for at in loads if at.getName().startswith("load=") and at.getName() not in used]
    newest = f"{state.number:010d}.json"
    old = [status.getPath() for status in files.listStatus(names.Path(folder, "_pointers"))]
    for at in [at for at in old if at.getName() != newest] + gone:
        files.delete(at, True)
    return len(gone)
