"""Tables that the engine itself keeps: where they lie, and what they were made of."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder serves a local master; a cluster's executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"folioquery-{spark.sparkContext.applicationId}")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it is made once, however often it is read, and outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of each file of a table: another one, once the table changes."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(place)] if not fs.getFileStatus(place).isDirectory() else list(fs.listStatus(place))
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in found))


def kept(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, made once for a key in an application."""
    context = spark.sparkContext
    if not hasattr(context, "_folioquery_kept"):
        context._folioquery_kept = {}
    if key not in context._folioquery_kept:
        context._folioquery_kept[key] = make()
    return context._folioquery_kept[key]


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores, for work that costs far more than moving a row: a small table is often one row group.

    Only what is read without a shuffle is looked at; counting the partitions of another plan would run it.
    """
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
