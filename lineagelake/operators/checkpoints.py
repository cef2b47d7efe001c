"""Cutting a long lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a written table go when it is written, not when the driver happens to collect its garbage.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where none is set, a session on one machine (as in tests) gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lineagelake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, removed at exit: computed once (a checkpoint computes twice), and of known size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lineagelake-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_remove_tables)
    _tables.append((spark, path))
    before = spark.conf.get(CLEAN_SETTING, "false")
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def _remove_tables() -> None:
    for spark, path in _tables:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the cluster's own cleaning takes over
            return
    _tables.clear()
