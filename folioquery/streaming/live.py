"""Tables that follow a stream: what a micro-batch changes is written as one version of a stored table, once, even if the batch runs again.

A batch's number is the note of the versions that it makes. A query that was stopped between the writing of a version and the
commit of its batch runs the batch again: tables that have its note are left alone, and what was stored before is read from
the version before that note.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioquery.operators import ledger as L
from folioquery.sources.segments import Segments


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the last by order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_last")).select(*(F.col("_last")[c].alias(c) if c != key else F.col(key) for c in rows.columns))


def followed(stream: DataFrame, store: Segments, checkpoint: str, order: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the newest row of each key of a stream in a stored table; a row that comes after a newer one of its key changes nothing.

    after(batch's rows as they are stored, batch) runs before the rows are stored.
    """

    def add(batch: DataFrame, number: int) -> None:
        place = f"{store.folder}/batches/{number:010d}"
        if store.version().note < number:  # else the rows are there, and what was written of them, too
            rows, stored = newest(batch, store.key, order), store.read(version=store.before(number))
            if stored is not None:
                late = stored.select(store.key, F.col(order).alias("_was")).join(rows.select(store.key, order), store.key).where(F.col(order) < F.col("_was")).select(store.key)
                rows = rows.join(late, store.key, "left_anti")
            rows.write.mode("overwrite").parquet(place)
        fresh = batch.sparkSession.read.parquet(place)
        if after:
            after(fresh, number)
        store.change(fresh, note=number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(stream: DataFrame, store: Segments, checkpoint: str) -> StreamingQuery:
    """New and changed files of a folder, a stream of (uri, modified_at, ...), as items that are PENDING: work to do outlives any run."""
    return followed(stream.withColumn("status", F.lit("PENDING")), store, checkpoint, "modified_at")


def work_off(store: Segments, done: Callable[[DataFrame], DataFrame]) -> int:
    """Works on all PENDING items of a stored table and stores what done() makes of them; how many there were. A run that is stopped leaves them PENDING."""
    live = store.read()
    pending = live.where("status = 'PENDING'") if live is not None else None
    if pending is None or pending.isEmpty():
        return 0
    before = store.version()
    after = store.change(done(pending))
    number = before.number + 1
    return after.segments[number] if number in after.segments else store._open(number).segments[number]


# ---- counts by status ----

def keep_status_counts(stream: DataFrame, items: Segments, counts: Segments, checkpoint: str) -> StreamingQuery:
    """items(id, status, at): each item's newest status; counts(status, items) follows: only statuses that an item enters or leaves are written."""

    def count(fresh: DataFrame, number: int) -> None:
        stored = items.read(version=items.before(number))
        after = fresh.select("status", F.lit(1).alias("n"))
        if stored is not None:
            after = after.unionByName(stored.join(fresh.select("id"), "id", "left_semi").select("status", F.lit(-1).alias("n")))
        delta = after.groupBy("status").agg(F.sum("n").alias("n")).where("n <> 0")
        held = counts.read(version=counts.before(number))
        now = delta.withColumn("items", F.lit(0)) if held is None else delta.join(held, "status", "left")
        now = now.select("status", (F.coalesce("items", F.lit(0)) + F.col("n")).alias("items"))
        counts.change(now.where("items > 0"), now.where("items = 0"), note=number)

    return followed(stream, items, checkpoint, "at", count)


# ---- the ledger ----

class LiveLedger:
    """Payments as they come, their months' totals kept up to date, and both as rows to show."""

    def __init__(self, spark: SparkSession, folder: str):
        self.payments = Segments(spark, f"{folder}/payments", "id")
        self.months = Segments(spark, f"{folder}/months", "month")

    def keep(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """A stream of payments(id, entry, ...); of one id the row of the greatest entry counts. Each batch writes its payments and the months that they change."""
        return followed(stream.withColumn("key", L.dedupe_key()), self.payments, checkpoint, "entry", self._count)

    def _count(self, fresh: DataFrame, number: int) -> None:
        """A payment changes the buckets of those that share its key, now or before; all of these are looked at, and no others."""
        stored = self.payments.read(version=self.payments.before(number))
        if stored is None:
            before, after = fresh.limit(0), fresh
        else:
            stored = stored.select(*fresh.columns)
            own = stored.join(fresh.select("id"), "id", "left_semi")
            keys = fresh.select("key").unionByName(own.select("key")).where("key IS NOT NULL").distinct()
            before = stored.join(keys, "key", "left_semi").unionByName(own.where("key IS NULL").select("key", *[c for c in own.columns if c != "key"])).select(*fresh.columns)
            after = before.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
        totals = lambda rows, sign: L.month_totals(L.buckets(rows)).select("month", (sign * F.col("total_paise")).alias("total_paise"), (sign * F.col("payments")).alias("payments"))
        delta = totals(after, 1).unionByName(totals(before, -1)).groupBy("month").agg(F.sum("total_paise").alias("dt"), F.sum("payments").alias("dp")).where("dt <> 0 OR dp <> 0")
        held = self.months.read(version=self.months.before(number))
        now = delta.select("*", F.lit(0).cast("long").alias("total_paise"), F.lit(0).cast("long").alias("payments")) if held is None else delta.join(held, "month", "left")
        now = now.select("month", (F.coalesce("total_paise", F.lit(0)) + F.col("dt")).alias("total_paise"), (F.coalesce("payments", F.lit(0)) + F.col("dp")).alias("payments"))
        self.months.change(now.where("payments > 0"), now.where("payments = 0"), note=number)

    def month_totals(self) -> DataFrame | None:
        return self.months.read()

    def with_items(self, items: DataFrame) -> DataFrame | None:
        """The stored payments with their items(item_id, ...), newest day first, those without a day last."""
        live = self.payments.read()
        return None if live is None else live.drop("key", "entry").join(items, "item_id").orderBy(F.desc_nulls_last("paid_date"), F.desc_nulls_last("paid_time"), "id")
