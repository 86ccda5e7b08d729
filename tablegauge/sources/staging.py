"""Cutting lineage: a table written once, read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. A local temporary one is no
    substitute: executors would not see what the driver or others wrote there."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError(f"{SETTING} is not set: intermediate tables need a folder that all executors share")
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For the input of algorithms that scan it several times. A lost executor
    then costs a re-read, not a re-run of everything before. The folder stays
    until ``drop_staged``, as the result is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the folders this process has staged; results that read them must
    have been written or collected. Returns how many there were."""
    count, jvm = len(_written), spark.sparkContext._jvm
    for path in _written:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()
    return count
