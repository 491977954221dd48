"""The folder that driver and executors share, and table helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder serves a local master; a cluster's executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"folioquery-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: For each block of scratch() that is open, the tables written in it.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in the block are deleted at its end, save those to keep, which are left to the block around it."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, keep: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives executors. keep: beyond so many blocks of scratch()."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    outer = _open[: max(0, len(_open) - keep)]
    if outer:
        outer[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(file system, path in it) for code on executors: the shared mount, or what pyarrow knows (hdfs, s3, gs)."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])
