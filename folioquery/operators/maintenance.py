"""Upkeep of what is stored: decisions and settings as logs, versions of tables, clearing, reports, vectors as bytes, runs over pending work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators import ingest
from folioquery.operators.retrieval import Index, build_index
from folioquery.sources.segments import Segments
from folioquery.sources.store import spread, written

MOST_ERROR = 300
#: Columns that later versions of the item table added, with their types and defaults.
ITEM_VERSIONS = {2: {"facts_version": ("int", 0)}, 3: {"ocr_engine": ("string", None)}, 4: {"telugu_pass": ("boolean", False)}}


def latest(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of a log that is only added to, the last row of each key by order; an aggregate with partial sums, so a busy key is no hot spot."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def decided(payments: DataFrame, decisions: DataFrame) -> DataFrame:
    """payments(id, decision, ...) with the last of decisions(id, decided_at, entry, decision); a null decision clears what was decided."""
    last = latest(decisions, ["id"], "decided_at", "entry").select("id", F.col("decision").alias("made"), F.lit(True).alias("said"))
    joined = payments.join(last, "id", "left").withColumn("decision", F.when(F.col("said"), F.col("made")).otherwise(F.col("decision")))
    return joined.select(*payments.columns)


def rates(log: DataFrame) -> DataFrame:
    """The exchange rates that hold: of log(from, to, rate, saved_on, entry) the last of each pair."""
    return latest(log, ["from", "to"], "saved_on", "entry")


def handled(reminders: DataFrame, log: DataFrame) -> DataFrame:
    """reminders(key, ...) whose last entry in log(key, at, entry, handled) doesn't say that they are handled."""
    done = latest(log, ["key"], "at", "entry").where("handled").select("key")
    return reminders.join(done, "key", "left_anti")


def migrate(rows: DataFrame, versions: dict[int, dict[str, tuple]] = ITEM_VERSIONS, of: int = 1) -> DataFrame:
    """rows of version `of` with the columns that later versions added, at their defaults; columns that are there keep their values."""
    for number in sorted(v for v in versions if v > of):
        for name, (kind, default) in versions[number].items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(default).cast(kind))
            elif default is not None:
                rows = rows.withColumn(name, F.coalesce(name, F.lit(default).cast(kind)))
    return rows


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Empties stored tables, each read from a folder of its own: it is overwritten by one of its columns without rows, so that it can be read on as before."""
    out = {}
    for name, df in tables.items():
        spark, schema = df.sparkSession, df.schema
        folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
        if len(folders) > 1:
            raise ValueError(f"{name} lies in {len(folders)} folders")
        for folder in folders:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
            out[name] = spark.read.schema(schema).parquet(folder)
        out.setdefault(name, df)  # it has no file, so no row
    return out


def insert_chunks(chunks: DataFrame, vectors: DataFrame, folder: str, version: int) -> tuple[Index, DataFrame]:
    """Chunks, postings and vectors of one version, in a folder of its own, marked complete last: a reader sees all of them or none."""
    place = f"{folder}/version={version:010d}"
    index = build_index(chunks, place)
    vectors.write.parquet(f"{place}/vectors")
    spark = chunks.sparkSession
    spark.createDataFrame([(version,)], "version int").write.parquet(f"{place}/complete")
    return index, spark.read.parquet(f"{place}/vectors")


def complete_version(spark: SparkSession, folder: str) -> int | None:
    """The newest version that was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/complete/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return max((int(x.getPath().getParent().getParent().getName().removeprefix("version=")) for x in found), default=None)


def write_report(rows: DataFrame, folder: str) -> DataFrame:
    """rows as lines of JSON, nulls kept; returns what is read back."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
    return rows.sparkSession.read.schema(rows.schema).json(folder)


@F.pandas_udf(T.BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bytes_vector(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def process(items: DataFrame, read: Callable[[str], int], most: int = MOST_ERROR) -> DataFrame:
    """items(id, text, ...) -> id, status, error, found: read() is run on each text by itself.

    A text that makes it raise is FAILED with the error's class and message; the others aren't touched by that. Texts without
    words are NO_TEXT. A task that is stopped leaves its items as they were: PENDING.
    """

    def one(text: str | None) -> tuple[str, str | None, int | None]:
        if not (text or "").strip():
            return "NO_TEXT", None, None
        try:
            return "INDEXED", None, read(text)
        except Exception as e:  # noqa: BLE001  the point is that nothing passes
            return "FAILED", f"{type(e).__name__}: {e}"[:most], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, error, found = zip(*map(one, batch.column(1).to_pylist())) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string()), pa.array(error, pa.string()), pa.array(found, pa.int64())], names=["id", "status", "error", "found"])

    return spread(items.select(F.col("id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "id long, status string, error string, found long")


def drain(items: DataFrame, read: Callable[[str], int]) -> DataFrame:
    """All of items(id, text, status) that are PENDING, processed in one job; the others as they are: id, status, error, found."""
    pending = F.col("status") == "PENDING"
    others = items.where(~pending).select("id", "status", F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("found"))
    return process(items.where(pending), read).unionByName(others)


def progress(items: DataFrame) -> DataFrame:
    """One row: how many items are done, and how many there are."""
    return items.agg(F.count_if(F.col("status") != "PENDING").alias("done"), F.count("*").alias("total"))


def catch_up(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: whether the newest of stored(added_at) is newer than anything in indexed(added_at), so that a run is due."""
    a = stored.agg(F.max("added_at").alias("in_store"))
    b = indexed.agg(F.max("added_at").alias("in_index"))
    return a.join(F.broadcast(b)).select("in_store", "in_index", F.coalesce(F.col("in_store") > F.col("in_index"), F.col("in_store").isNotNull()).alias("run"))  # a row each


def bounded_bursts(changes: DataFrame, key: str, quiet: int = 10, most: int = 60) -> DataFrame:
    """Bursts of changes(at, key): key, start, fired, changes. A burst ends after `quiet` seconds without a change, or `most` after
    its first one; the next change starts another. Rows pass in the order of key and time; only the open burst is held.
    """
    rows = changes.select(F.col(key).cast("string").alias("key"), F.col("at").cast("timestamp").alias("at")).where("at is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # key, first, last, changes
        for batch in batches:
            out = []
            times = batch.column(1).cast(pa.int64()).to_pylist()
            for k, at in zip(batch.column(0).to_pylist(), times):
                if now and (k != now[0] or at > min(now[2] + quiet * 1_000_000, now[1] + most * 1_000_000)):
                    out.append(now)
                    now = None
                now = (k, at, at, 1) if now is None else (k, now[1], at, now[3] + 1)
            if out:
                yield told(out)
        if now:
            yield told([now])

    def told(bursts: list[tuple]) -> pa.RecordBatch:
        ends = [min(last + quiet * 1_000_000, first + most * 1_000_000) for _, first, last, _ in bursts]
        kind = pa.timestamp("us", "UTC")
        return pa.RecordBatch.from_arrays([pa.array([b[0] for b in bursts], pa.string()), pa.array([b[1] for b in bursts], pa.int64()).cast(kind), pa.array(ends, pa.int64()).cast(kind), pa.array([b[3] for b in bursts], pa.int64())], names=["key", "start", "fired", "changes"])

    found = rows.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, "key string, start timestamp, fired timestamp, changes long")
    return found.withColumnRenamed("key", key)


def backfill(items: Segments, facts: Segments, version: int, read: Callable[[DataFrame], DataFrame]) -> int:
    """Reads the facts of items anew that were read by older rules; how many items there were.

    items(id, text, status, facts_version, ...) and facts(fact_id, item_id, ...) are stored tables; read(items(item_id, text))
    gives the facts of these items, fact_ids included. Only outdated items and their facts are written, the items with the
    stamp last: a run that is stopped between the two finds them outdated again and replaces the same facts.
    """
    live = items.read()
    due = ingest.outdated(live, version) if live is not None else None
    if due is None or due.isEmpty():
        return 0
    due = written(due, "outdated-items")
    own = facts.read()
    gone = own.join(due.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("fact_id") if own is not None else None
    new = written(read(due.select(F.col("id").alias("item_id"), "text")), "facts-read")
    facts.change(new, gone if gone is None else gone.join(new.select("fact_id"), "fact_id", "left_anti"))
    items.change(due.withColumn("facts_version", F.lit(version)), unique=True)
    return due.count()


def counts(**tables: DataFrame) -> DataFrame:
    """name and rows of each table: items, pending, indexed, chunks, vectors, facts, payments, notifications and the like."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def default_month(picked: Column) -> Column:
    """The picked month if rows(month, ...) have it, else their newest; an aggregate."""
    return F.coalesce(F.max(F.when(F.col("month") == picked, F.col("month"))), F.max("month"))
