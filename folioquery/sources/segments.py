"""A stored table that changes by deltas: segments of rows, tombstones beside them, and versions that name both.

An insertion writes one segment, a deletion one table of keys. A tombstone holds for the segments that are older than it, so
that a key can come back. Tables derived from the rows, such as postings, are written with each segment and read through the
same tombstones. Once several segments are of one size class they are merged into one, which drops their dead rows; the rest
of the table isn't touched, so a row is rewritten about once for each class that it rises through.

A version is written last and never changed: readers see the whole of it or the one before. One writer at a time is assumed;
of two that make the same version the second fails. What a writer left that was stopped is overwritten, or goes by vacuum().
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of one size class that are merged; rows of the smallest class, and how many times more the next one holds.
MERGED, SMALLEST, CLASS = 4, 10_000, 4
#: Tombstones that are broadcast; more are joined.
SENT_TOMBSTONES = 1_000_000
SEGMENT = "_segment"

Derive = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Version:
    """segments: number -> rows written; tombstones: number -> keys; dead: number of a segment -> its rows that tombstones hold for;
    rows, weight, signature: of what is live; note: the last that a writer gave."""

    number: int = 0
    segments: dict[int, int] = field(default_factory=dict)
    tombstones: dict[int, int] = field(default_factory=dict)
    dead: dict[int, int] = field(default_factory=dict)
    rows: int = 0
    weight: int = 0
    signature: int = 0
    note: int = -1


class Segments:
    """rows(key, ...) in a folder; derived: tables made from rows, which have the key, too; weight: a whole number of each row, whose sum is kept."""

    def __init__(self, spark: SparkSession, folder: str, key: str, derived: dict[str, Derive] | None = None, weight: Callable[[], Column] | None = None):
        self.spark, self.folder, self.key, self.derived = spark, folder.rstrip("/"), key, derived or {}
        self.weight = weight or (lambda: F.lit(0))

    # ---- versions ----

    def _numbers(self) -> list[int]:
        """Of the versions that were written to their end, the newest first."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        return sorted((int(x.getPath().getParent().getName()) for x in found), reverse=True)

    def _open(self, number: int) -> Version:
        own = json.loads(self.spark.read.text(f"{self.folder}/versions/{number:010d}").first()[0])
        return Version(**own | {name: {int(k): n for k, n in own.get(name, {}).items()} for name in ("segments", "tombstones", "dead")})

    def version(self) -> Version:
        """The newest version."""
        numbers = self._numbers()
        return self._open(numbers[0]) if numbers else Version()

    def before(self, note: int) -> Version:
        """The newest version of a lesser note."""
        return next((v for v in map(self._open, self._numbers()) if v.note < note), Version())

    def _commit(self, version: Version) -> Version:
        """A segment without live rows goes, but for the newest, and with it the tombstones that held for older ones only."""
        newest = max(version.segments, default=0)
        segments = {k: n for k, n in version.segments.items() if k == newest or n > version.dead.get(k, 0)}
        version = replace(version, segments=segments, dead={k: n for k, n in version.dead.items() if k in segments})
        least = min(version.segments, default=version.number + 1)
        version = replace(version, tombstones={k: n for k, n in version.tombstones.items() if k > least})
        self.spark.createDataFrame([(json.dumps(version.__dict__),)], "value string").coalesce(1).write.text(f"{self.folder}/versions/{version.number:010d}")
        return version

    def _place(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/{number:010d}"

    # ---- reading ----

    def read(self, name: str = "rows", version: Version | None = None, only: set[int] | None = None, segment: bool = False) -> DataFrame | None:
        """The live rows, or those of a derived table; None if there never was a segment. only: of these segments; segment: with its number as a column."""
        version = version or self.version()
        numbers = [k for k in version.segments if only is None or k in only]
        if not numbers:
            return None
        whole = None
        for k in numbers:
            part = self.spark.read.parquet(self._place(name, k)).withColumn(SEGMENT, F.lit(k).cast("long"))
            whole = part if whole is None else whole.unionByName(part)
        dead = {k: n for k, n in version.tombstones.items() if k > min(numbers)}
        if dead:
            keys = None
            for k in dead:
                part = self.spark.read.parquet(self._place("tombstones", k)).select(self.key, F.lit(k).cast("long").alias("_dead"))
                keys = part if keys is None else keys.unionByName(part)
            keys = keys.groupBy(self.key).agg(F.max("_dead").alias("_dead"))
            whole = whole.join(F.broadcast(keys) if sum(dead.values()) <= SENT_TOMBSTONES else keys, self.key, "left")
            whole = whole.where(F.col("_dead").isNull() | (F.col(SEGMENT) >= F.col("_dead"))).drop("_dead")
        return whole if segment else whole.drop(SEGMENT)

    # ---- writing ----

    def _sums(self, rows: DataFrame) -> tuple[int, int, int]:
        """Number, weight and sum of hashed keys; the last wraps around."""
        hashed = F.pmod(F.xxhash64(self.key), F.lit(1 << 31))
        n, weight, signature = rows.agg(F.count("*"), F.coalesce(F.sum(self.weight().cast("long")), F.lit(0)), F.coalesce(F.sum(hashed), F.lit(0))).first()
        return n, weight, signature

    def _write_segment(self, rows: DataFrame, number: int) -> tuple[int, int, int]:
        rows.write.mode("overwrite").parquet(self._place("rows", number))  # a writer that was stopped may have left something
        own = self.spark.read.parquet(self._place("rows", number))
        for name, derive in self.derived.items():
            derive(own).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(self._place(name, number))
        return self._sums(own)

    def change(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, note: int | None = None, unique: bool = False) -> Version:
        """One version further: rows of upserts replace those of their keys, keys of deletes go. Only these are written.

        unique: no key comes twice in upserts, as in what read() gave; else one row of each key is taken, which shuffles whole rows.

        note: a number that grows from change to change, such as that of a stream's batch; a change whose note is there
        already isn't made again.
        """
        old = self.version()
        if note is not None and old.note >= note:
            return old
        number = old.number + 1
        rows, weight, signature = old.rows, old.weight, old.signature
        segments, tombstones, dead_rows = dict(old.segments), dict(old.tombstones), dict(old.dead)
        # Segments first: what they hold is read by their tombstones.
        if upserts is not None:
            added = self._write_segment(upserts if unique else upserts.dropDuplicates([self.key]), number)
            if added[0] or not segments:
                segments[number] = added[0]
                rows, weight, signature = rows + added[0], weight + added[1], signature + added[2]
        live = self.read(version=old, segment=True)
        if live is not None:
            gone = self.spark.read.parquet(self._place("rows", number)).select(self.key) if number in segments else None
            if deletes is not None:
                gone = deletes.select(self.key) if gone is None else gone.unionByName(deletes.select(self.key))
            if gone is not None:
                dying = live.join(gone.distinct(), self.key, "left_semi").select(self.key, SEGMENT, self.weight().cast("long").alias("_weight"))
                dying.write.mode("overwrite").parquet(self._place("tombstones", number))
                dead = self.spark.read.parquet(self._place("tombstones", number))
                sums = [F.count("*"), F.coalesce(F.sum("_weight"), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64(self.key), F.lit(1 << 31))), F.lit(0))]
                for k, n, lost, keys in dead.groupBy(SEGMENT).agg(*sums).collect():  # a row for each segment
                    tombstones[number] = tombstones.get(number, 0) + n
                    dead_rows[k] = dead_rows.get(k, 0) + n
                    rows, weight, signature = rows - n, weight - lost, signature - keys
        return self.merge(self._commit(Version(number, segments, tombstones, dead_rows, rows, weight, signature, old.note if note is None else note)))

    def refresh(self, rows: DataFrame, new_keys: bool = False) -> Version:
        """Brings the table to what rows are; of them and of the stored rows only what differs is written.

        new_keys: another content always has another key, so that equal numbers of rows and equal sums of keys say that
        nothing changed. Else contents are compared, by a hash of all columns.
        """
        old = self.version()
        live = self.read(version=old)
        if live is None:
            return self.change(rows)
        if new_keys:
            n, _, signature = self._sums(rows)
            if (n, signature) == (old.rows, old.signature):
                return old
        digest = F.xxhash64(*[c for c in sorted(rows.columns) if c != self.key])
        stored = live.select(self.key, digest.alias("_was"))
        both = rows.select(self.key, digest.alias("_is")).join(stored, self.key, "full")
        new = both.where(~F.col("_is").eqNullSafe(F.col("_was")) & F.col("_is").isNotNull()).select(self.key)
        gone = both.where(F.col("_is").isNull()).select(self.key)
        some_new, some_gone = (not x.isEmpty() for x in (new, gone))
        if not some_new and not some_gone:
            return old
        return self.change(rows.join(new, self.key, "left_semi") if some_new else None, gone if some_gone else None)

    def merge(self, version: Version | None = None) -> Version:
        """Merges the segments of a size class that has MERGED of them, as often as it takes."""
        version = version or self.version()
        while True:
            classes: dict[int, list[int]] = {}
            for k, n in version.segments.items():
                size = 0
                while n >= SMALLEST * CLASS**size:
                    size += 1
                classes.setdefault(size, []).append(k)
            full = next((own for size, own in sorted(classes.items()) if len(own) >= MERGED), None)
            if full is None:
                return version
            number = version.number + 1
            n, *_ = self._write_segment(self.read(version=version, only=set(full)), number)
            segments = {k: m for k, m in version.segments.items() if k not in full} | ({number: n} if n else {})
            version = self._commit(replace(version, number=number, segments=segments))  # a merged segment has no dead rows

    def vacuum(self) -> list[str]:
        """Deletes what the newest version doesn't need, for when no reader holds an older one; returns the folders."""
        version, gone = self.version(), []
        needed = {("versions", version.number)} | {("tombstones", k) for k in version.tombstones} | {(name, k) for name in ("rows", *self.derived) for k in version.segments}
        for name in ("rows", *self.derived, "tombstones", "versions"):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/*")
            fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for x in fs.globStatus(place) or []:
                if (name, int(x.getPath().getName())) not in needed:
                    gone.append(f"{name}/{x.getPath().getName()}")
                    fs.delete(x.getPath(), True)
        return gone
