"""Ingestion: content hashes, duplicates, status, reconciling a scan with what is stored, retention, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.text import clean_lines

LEAST_SIDE, MOST_FILES, SALTS = 200, 1000, 16


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def statuses(items: DataFrame) -> DataFrame:
    """items(id, added_at, text, failed, ...) with content_hash and status, without text.

    Of equal contents the newest that doesn't fail is worked on (ties: the larger id), the others are DUPLICATE. The winner
    of each hash is found by an aggregate with partial sums, so that a content of any number of copies is no hot spot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    # Texts stay behind: only their hashes, and whether they have any line, are joined.
    rows = items.withColumns({"content_hash": content_hash(text), "empty": F.size(clean_lines(text)) == 0, "salt": salt}).drop("text")
    winners = rows.where(~F.col("failed")).groupBy("content_hash").agg(F.max(F.struct("added_at", "id"))["id"].alias("winner"), F.count("*").alias("n"))
    copied = winners.where("n > 1").select("content_hash", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    status = F.when(F.col("failed"), "FAILED").when(F.col("winner") != F.col("id"), "DUPLICATE").when(F.col("empty"), "NO_TEXT").otherwise("INDEXED")
    return rows.join(copied, ["content_hash", "salt"], "left").withColumn("status", status).drop("winner", "empty", "salt")


def scan(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """files(uri, added_at, width, height, ...): the newest most whose shorter side is LEAST_SIDE or more."""
    return files.where(F.least("width", "height") >= LEAST_SIDE).orderBy(F.desc("added_at"), F.desc("uri")).limit(most)


def scan_result(files: DataFrame, existing: DataFrame, access: str, most: int = MOST_FILES) -> DataFrame:
    """One row: seen, added, changed, removed, skipped_small, of a scan with access FULL, PARTIAL or NONE (which looks at nothing).

    Files are those that scan() takes; a small one is skipped. What is gone is told only by a scan with FULL access that
    found fewer files than it takes.
    """
    if access == "NONE":
        return files.sparkSession.createDataFrame([(0, 0, 0, 0, 0)], "seen long, added long, changed long, removed long, skipped_small long")
    small = F.least("width", "height") < LEAST_SIDE
    newest = F.struct("added_at", "uri")
    # The files that are taken are those from the last of them on, so that the small ones between them are told, too.
    taken = scan(files, most)
    ends = taken.agg(F.min(newest).alias("last"), F.count("*").alias("seen"))
    skipped = files.join(F.broadcast(ends)).where(small & ((F.col("seen") < most) | (newest > F.col("last")))).agg(F.count("*").alias("skipped_small"))
    both = reconcile(taken, existing, complete=access == "FULL").groupBy().agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")])
    whole = ends.select("seen").join(F.broadcast(both)).join(F.broadcast(skipped))  # a row each
    return whole.select("seen", "added", "changed", F.when(F.col("seen") < most, F.col("removed")).otherwise(0).alias("removed"), "skipped_small")


def indexed_copies(items: DataFrame) -> DataFrame:
    """items(id, content_hash, status) -> id, copies: how many others of that content are INDEXED or NO_TEXT; by counts, which have partial sums."""
    worked = F.col("status").isin("INDEXED", "NO_TEXT")
    known = items.where(worked).groupBy("content_hash").agg(F.count("*").alias("n"))
    return items.join(known, "content_hash", "left").select("id", (F.coalesce("n", F.lit(0)) - worked.cast("int")).alias("copies"))


def reconcile(scanned: DataFrame, existing: DataFrame, complete: bool) -> DataFrame:
    """uri and change (added, changed, same, removed); removed only if the scan was complete. Both have uri, modified_at, size_bytes."""
    old = existing.select("uri", F.col("modified_at").alias("old_time"), F.col("size_bytes").alias("old_size"), F.lit(True).alias("known"))
    new = scanned.select("uri", "modified_at", "size_bytes", F.lit(True).alias("seen"))
    differs = (F.col("modified_at") != F.col("old_time")) | (F.col("size_bytes") != F.col("old_size"))
    change = F.when(F.col("known").isNull(), "added").when(F.col("seen").isNull(), "removed").when(differs, "changed").otherwise("same")
    both = new.join(old, "uri", "full").select("uri", change.alias("change"))
    return both if complete else both.where("change <> 'removed'")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those of new whose key isn't there yet."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and those of stored whose key isn't in it."""
    return stored.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], removed: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows of removed items; keys: a table's column that holds the item's id."""
    return {name: df.join(removed.select(F.col("id").alias(keys[name])), keys[name], "left_anti") for name, df in tables.items()}


def replace_payments(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Payments read anew replace those of their items; decisions made before stay."""
    kept = stored.select("item_id", F.col("decision").alias("made"))
    fresh = new.join(kept, "item_id", "left").withColumn("decision", F.coalesce("made", "decision")).drop("made")
    return upsert(stored, fresh.select(*stored.columns), ["item_id"])


def retain(rows: DataFrame, now_ms: int, days: int = 30, most: int = 5000) -> DataFrame:
    """rows(id, posted_at, ...) not older than days, and of those the newest most."""
    fresh = rows.where(F.col("posted_at") >= now_ms - days * 86_400_000)
    return fresh.orderBy(F.desc("posted_at"), F.desc("id")).limit(most)


def retry_failed(items: DataFrame) -> DataFrame:
    failed = F.col("status") == "FAILED"
    return items.withColumn("error", F.when(~failed, F.col("error"))).withColumn("status", F.when(failed, "PENDING").otherwise(F.col("status")))


def outdated(items: DataFrame, version: int) -> DataFrame:
    """Indexed items whose facts were read by older rules."""
    return items.where((F.col("status") == "INDEXED") & (F.col("facts_version") < version))
