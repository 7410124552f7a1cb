"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset in a local session (tests, local runs) it is a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "siftloom-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: its lineage ends there.

    A table, as ``DataFrame.checkpoint`` runs its plan twice and keeps no columns apart.
    Tables lie in one folder an application, which is removed when its JVM ends. Columns
    of type void can't be written.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    top = f"{shared_folder(spark)}/siftloom-{sc.applicationId}"
    jvm = sc._jvm
    folder = jvm.org.apache.hadoop.fs.Path(top)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
