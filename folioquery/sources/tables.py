"""Tables read from Parquet, with only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Whole files as rows: uri, modified_at, size_bytes, content (read only where it is used)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return df.selectExpr("path AS uri", "modificationTime AS modified_at", "length AS size_bytes", "content")


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document or lines of JSON."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)
