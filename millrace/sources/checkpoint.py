"""Reliable checkpoints in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). One of our own is set only where none is configured, as in tests."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not shared and sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share.")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends there, partitions stay as they are, and lost executors cost nothing that was done before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table."""
    return f"{checkpoint_dir(spark)}/{name}-{os.urandom(8).hex()}"


#: Spark's setting by which a query's shuffle files go when it has ended; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in it leaves no shuffle files."""
    usual = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, usual)


def kept(df: DataFrame) -> DataFrame:
    """df written once as compressed Parquet below the shared folder. Takes a small part of a checkpoint's disk, and columns that nobody asks for aren't read.

    The shuffles that made it are removed when it is written. Partitions aren't those of df, and its rows are in df's order within the files, whose names are numbered in the order of its partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "kept")
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
