"""Tables written to the folder that all executors share, and read back: they cut lineage and survive lost executors.

The folder is the one named by ``spark.checkpoint.dir``; only a session of one machine without that setting (tests, a
notebook) gets a temporary one. On a cluster its absence is an error: a folder of the driver is not shared.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandloom-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again; scratch space that :func:`unstage` removes."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # type: ignore[attr-defined]
    return out


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has staged. Results that were not written yet can no longer be read."""
    _remove(spark, _own(spark))
