"""Shared scratch space: tables written to cut lineage, readable by every executor and by the driver."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where the setting is absent, a temporary one on a local master; on
    a cluster that is an error, as executors don't share the driver's folders."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="theoremill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; nothing can be cleaned through it
        pass


#: Spark's setting to drop the shuffle files of a query when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df as Parquet in the scratch folder and read it back: cuts lineage, survives lost executors. tidy: for large
    tables; compressed more, and the shuffle files of df go at once, not when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/theoremill/{name}-{uuid.uuid4().hex}"
    if tidy:
        before = spark.conf.get(_CLEAN, "false")
        spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEAN, before)
    else:
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables made by materialize that nothing will read any more."""
    for table in tables:
        _remove(table.sparkSession, table.scratch_path)
