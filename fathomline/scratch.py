"""Tables that a job writes for itself in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/fathomline-shared"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that no other run uses, in spark.checkpoint.dir, under a folder of the application's own that is removed when its JVM ends.

    A local master may leave the setting unset, a cluster may not.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"{(named or LOCAL_SHARED).rstrip('/')}/fathomline-{sc.applicationId}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if files.mkdirs(folder):
        files.deleteOnExit(folder)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table: computed once however often they are read, and not lost with an executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows cut from their lineage by checkpoint(), in the same partitions and order however often they are read."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(fresh_path(spark, "checkpoints"))
    return df.checkpoint()
