"""Incremental processing with Structured Streaming: notification history, ingestion of changed folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import ingest, notifications

KEY = ["package", "posted_at", "title", "text"]


def distinct_notifications(stream: DataFrame, own_package: str, delay: str = "30 days") -> DataFrame:
    """What belongs in the history, each natural key once; state is kept for as long as events may be late."""
    rows = notifications.kept(stream, own_package).withColumn("posted", F.timestamp_millis("posted_at"))
    return rows.withWatermark("posted", delay).dropDuplicatesWithinWatermark(KEY)


def keep_history(stream: DataFrame, path: str, checkpoint: str, own_package: str, days: int = 30, most: int = 5000):
    """Each batch joins the stored history: insert-ignore by key, retention by the newest time seen, a cap on rows.

    Versions of the history are written side by side and never changed, so that a batch that runs again gives the same.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = notifications.kept(batch, own_package).dropDuplicates(KEY)
        old = latest(spark, path, number)
        whole = fresh if old is None else ingest.insert_ignore(old.select(*fresh.columns), fresh, KEY)
        now = whole.agg(F.max("posted_at")).first()[0]
        kept = ingest.retain(whole, now, days, most) if now is not None else whole
        kept.write.mode("overwrite").parquet(f"{path}/version={number:010d}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest stored version (of those before a batch), or None."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{path}/version={numbers[-1]:010d}") if numbers else None


def status_counts(stream: DataFrame) -> DataFrame:
    """Counts by status that follow the stream; for outputMode('complete') or 'update'."""
    return stream.groupBy("status").agg(F.count("*").alias("items"))


def quiet_periods(changes: DataFrame, key: str, quiet: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Bursts of changes(at, key, ...) that a quiet period ends: key, start, end, changes."""
    bursts = changes.withWatermark("at", delay).groupBy(F.session_window("at", quiet).alias("w"), key).agg(F.count("*").alias("changes"))
    return bursts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")
