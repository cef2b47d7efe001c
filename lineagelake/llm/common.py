"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space; the same in Java, RE2 and (on bytes) Python's split().
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch while a table is written. Batches of whole texts are large: Spark's 10,000 rows take some 100 MB
#: beside the heap for each task, and grow with the texts.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of a written table go when it is written, not when the driver happens to collect its garbage.
_CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or its checkpoint folder.

    Where neither is set, a session on one machine (as in tests) gets a temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lineagelake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. Removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lineagelake-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    before, clean = spark.conf.get(_BATCH_SETTING), spark.conf.get(_CLEAN_SETTING, "false")
    spark.conf.set(_BATCH_SETTING, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    spark.conf.set(_CLEAN_SETTING, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_BATCH_SETTING, before)
        spark.conf.set(_CLEAN_SETTING, clean)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = (spark, path)
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of written() that no result still reads."""
    for df in tables:
        _remove(*df.written_at)
        _written.remove(df.written_at)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaning takes over
            return
    _written.clear()


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
