"""Debouncing of a stream of changes: a burst fires once it has been quiet for a while, or after its longest time, and the next change starts another.

Each key holds the times of its changes that haven't fired, and one event timer at the end of its oldest burst. The watermark
is what makes a burst final: a change that could still lengthen it would be late. So what fires doesn't depend on how changes
are dealt to micro-batches, nor on restarts, which find the times in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUIET, MOST = 10, 60


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Queries that start in the block keep their state where timers need it; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


def first_burst(times: list[int], quiet: int, most: int) -> tuple[int, int]:
    """(how many of sorted times belong to the first burst, when it fires), all in microseconds."""
    last = times[0]
    for k, at in enumerate(times):
        if at > min(last + quiet, times[0] + most):
            return k, min(last + quiet, times[0] + most)
        last = at
    return len(times), min(last + quiet, times[0] + most)


class Debounce(StatefulProcessor):
    """Rows (key, at in microseconds) become (key, start, fired, changes), one for each burst."""

    def __init__(self, quiet: int, most: int):
        self.quiet, self.most = quiet * 1_000_000, most * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "changes long")

    def times(self) -> list[int]:
        return sorted(k[0] for k in self.waiting.keys())

    def arm(self, times: list[int]) -> None:
        """One timer, at the end of the first burst."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            _, fires = first_burst(times, self.quiet, self.most)
            self.handle.registerTimer(-(-fires // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in rows:
            held = self.waiting.getValue((row.at,)) if self.waiting.containsKey((row.at,)) else (0,)
            self.waiting.updateValue((row.at,), (held[0] + 1,))
        self.arm(self.times())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, times = timerValues.getCurrentWatermarkInMs() * 1000, self.times()
        while times:
            size, fires = first_burst(times, self.quiet, self.most)
            if fires > now:
                break
            changes = 0
            for at in times[:size]:
                changes += self.waiting.getValue((at,))[0]
                self.waiting.removeKey((at,))
            yield Row(key=key[0], start=times[0], fired=fires, changes=changes)
            times = times[size:]
        self.arm(times)

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, key: str, quiet: int = QUIET, most: int = MOST, delay: str = "1 minute") -> DataFrame:
    """Bursts of a stream of changes(at, key, ...) in append mode: key, start, fired, changes, as bounded_bursts() finds them in a table.

    A burst fires `quiet` seconds after its last change, or `most` after its first, once the watermark has passed that time;
    a change later than `delay` is left out. Changes without a time are left out; a null key is a key of its own, as text.
    """
    rows = changes.select(F.col(key).cast("string").alias("key"), F.col("at").cast("timestamp").alias("time")).where("time is not null").withWatermark("time", delay)
    rows = rows.select("key", "time", F.unix_micros("time").alias("at"))
    found = rows.groupBy("key").transformWithState(
        statefulProcessor=Debounce(quiet, most), outputStructType="key string, start long, fired long, changes long", outputMode="append", timeMode="eventTime"
    )
    return found.select(F.col("key").alias(key), F.timestamp_micros("start").alias("start"), F.timestamp_micros("fired").alias("fired"), "changes")
