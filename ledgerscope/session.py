"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session you have."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerscope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small local inputs: keep all cores busy after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERSCOPE_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a
    cluster a machine-local folder would not survive the loss of its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerscope-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def release(spark: SparkSession) -> None:
    """Lets go of finished jobs, so that Spark's context cleaner removes their shuffle files now.

    The cleaner acts when the driver's JVM collects garbage, which a driver with little
    to do puts off while the files fill the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder as Parquet and reads it back: a short lineage,
    and later passes read only their columns. The files go when the application ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
