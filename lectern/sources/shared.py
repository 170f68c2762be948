"""Shared storage: tables that are written once, so that what made them doesn't run again for each use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, one in the temporary folder of this machine, if all tasks run on it too; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/lectern-{uuid.uuid4().hex}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Of what is written: the path, and the JVM's weak reference to the file index that every plan over it holds.
written: list[tuple] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    written.append((path, spark._jvm.java.lang.ref.WeakReference(found._jdf.queryExecution().analyzed().relation().location())))
    return found
