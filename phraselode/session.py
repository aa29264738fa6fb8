"""Sessions, and cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, name: str = "phraselode", memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session is a
    local one is a temporary folder made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="phraselode-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later readers neither recompute it nor lose it.

    Where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, Spark frees it when no plan refers to it any more,
    so that an iteration keeps its last steps only.
    """
    checkpoint_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    # A checkpoint keeps the estimated size of the plan it replaces, and a join's estimate is the product of its
    # sides': over the rounds of an iteration the number itself would fill the driver. Absurd ones are forgotten.
    if done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() > 96:
        spark = df.sparkSession
        rows = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
        return DataFrame(rows, spark)
    return done


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer partitions than these, such as a single small file; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
