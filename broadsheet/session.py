"""Session set-up and the two helpers that need the session itself."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []

INPUT_PARTITIONS = "broadsheet.input.partitions"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(
    master: str = "local[*]", shuffle_partitions: int | None = None, input_partitions: int | None = None
) -> SparkSession:
    """A session for local work. On a cluster use the session you are given.

    ``input_partitions`` is for inputs in one piece; see ``spread``.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("broadsheet")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if input_partitions:
        spark.conf.set(INPUT_PARTITIONS, str(input_partitions))
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` of the session, or else the folder given to
    ``SparkContext.setCheckpointDir``. Where both are unset, a session that runs in one
    process sets a folder of its own; any other is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="broadsheet-"))
    return context.getCheckpointDir().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A path not yet used under ``shared_base``."""
    path = f"{shared_base(spark)}/broadsheet/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the folders that this process has asked for so far; how many there were.

    Call it when results that were built on them have been written. Frames that still read
    them can no longer be evaluated.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives Catalyst the
    true size of the result, so a later join is broadcast only when that size allows it.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str = "identifier") -> DataFrame:
    """Deal rows to as many tasks as ``broadsheet.input.partitions`` says, if it is set.

    For an input in one piece (one row group, one gzip file) that a single task would read.
    Where it is not set, the scan stays as it is.
    """
    tasks = df.sparkSession.conf.get(INPUT_PARTITIONS, "")
    return df.repartition(int(tasks), F.col(key)) if tasks else df
