"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

BROADCAST_ROWS = 100_000  # narrow rows small enough to send to every executor
SPREAD_ROWS = 200_000  # rows of costly expressions that one task may take

_local_scratch: str | None = None
_staged: list[str] = []  # tables this process has written and not yet released


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a machine-local folder: on a cluster
    the other executors could not read what is written there.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="lakelens-scratch-")
    return _local_scratch


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the scratch folder and read it back.

    Later stages then depend on files, not on executors, and every row gets a
    fixed position (``_metadata.file_path``, ``_metadata.row_index``). A sorted
    relation is written in its order: one file per task, numbered by task.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lakelens-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("maxRecordsPerFile", 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables staged so far; how many there were.

    To be called once results that read them have been written or are no longer
    wanted: relations numbered, paged or sampled before it cannot be read after it.
    """
    done = 0
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done += bool(files.delete(path, True))
    return done


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out over all cores, and over tasks of at most ``SPREAD_ROWS`` rows.

    A small file stored as one row group would keep one core busy with costly
    expressions, and a split of a large one holds millions of rows. A scan with enough
    splits is left as it is, without a shuffle; its rows are counted from footers.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / SPREAD_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``limit`` rows; leave it to Spark if not.

    The rows fetched for the check are the rows sent, so ``df`` runs once.
    """
    head = df.limit(limit + 1).toArrow()
    if head.num_rows > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))
