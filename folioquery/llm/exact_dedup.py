"""Exact dedup through an extendible-hash index on shared files; DataFrame operations only.

A text's key is a 64-bit hash of it, of which a bucket holds all that begin with the same bits. The directory maps a key's
first bits to its bucket. It doubles - takes one bit more - as long as a bucket holds more distinct keys than CAPACITY, and
only the overfull buckets split; the others keep their local depth, and several slots lead to them. Each bucket has one
owner task, which writes its entries in the order of keys. Texts that share a key are told apart by their bytes and chain
behind one another as records of their own. A row is looked up by directory slot, bucket and key, and in a chain by digest
and size. Copies of a text are counted where they are read, so that a group of any size reaches its owner as a row for each
reading task. Directory, index and keyed rows are tables in the shared folder; nothing of them comes to the driver but a
bucket's greatest size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.shared import scratch, written

#: Distinct keys of a bucket; slots that a directory has at first for each full bucket, as a power of two; bits of a key.
CAPACITY, FINER, MOST_BITS = 4096, 3, 62
#: The rows of one text are looked up in so many tasks.
SALTS = 16
#: Slots of a directory that is broadcast; a larger one is joined.
BROADCAST_SLOTS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def first_bits(value: Column, bits: Column | int, of: int) -> Column:
    """The first bits of a value of so many bits; their number may be a column."""
    return F.expr("0L") if isinstance(bits, int) and not bits else F.when(F.lit(bits) == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", value, (F.lit(of) - F.lit(bits)).cast("int")))


def keyed(documents: DataFrame, row: str | None = None) -> DataFrame:
    """Each row with its normalised text (null is empty; A-Z in lower case) and the text's key; row names a column that tells rows apart."""
    norm = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = documents.select(F.col("doc_id").cast("long"), F.col(row).cast("long").alias("row") if row else F.lit(0).cast("long").alias("row"), norm.alias("norm"))
    return rows.select("doc_id", "row", "norm", F.xxhash64("norm").alias("key"))


def directory(keys: DataFrame, rows: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of the directory of distinct keys(key), and the number of its bits.

    slot: the first bits of a key, where there are keys; bucket: the least slot of the bucket; depth: its own bits.
    """
    with scratch(keys.sparkSession):
        return doubled(keys, max(1, math.ceil(math.log2(max(2, rows) / capacity)) + FINER), capacity)


def doubled(keys: DataFrame, bits: int, capacity: int) -> tuple[DataFrame, int]:
    """directory(), with this many bits at least."""
    while True:  # with more bits if a slot is itself overfull, as keys that share many bits are
        slots = written(keys.groupBy(first_bits(F.col("key"), bits, 64).alias("slot")).agg(F.count("*").alias("n")), "directory-slots")
        fullest = slots.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity or bits >= MOST_BITS:
            break
        bits = min(MOST_BITS, bits + max(1, math.ceil(math.log2(fullest / capacity))))
    # All doublings at once: a bucket of a depth stands where it fits into the capacity and its parent overflows.
    depths = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    sums = depths.groupBy("depth", first_bits(F.col("slot"), F.col("depth"), bits).alias("prefix")).agg(F.sum("n").alias("n"))
    sums = written(sums, "directory-levels")
    parents = sums.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    full = F.col("n") > capacity
    roots = sums.where("depth = 0").where(~full).select("depth", "prefix")
    below = sums.where(~full | (F.col("depth") == bits)).withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(parents, ["depth", "parent"]).select("depth", "prefix")
    buckets = roots.unionByName(below)
    found = depths.select("slot", "depth", first_bits(F.col("slot"), F.col("depth"), bits).alias("prefix")).join(buckets, ["depth", "prefix"])
    bucket = F.call_function("shiftleft", F.col("prefix"), (F.lit(bits) - F.col("depth")).cast("int"))
    return written(found.select("slot", bucket.alias("bucket"), "depth"), "directory", keep=1), bits


def placed(rows: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """rows(key, ...) with bucket and depth, by the directory."""
    few = slots.count() <= BROADCAST_SLOTS
    return rows.withColumn("slot", first_bits(F.col("key"), bits, 64)).join(F.broadcast(slots) if few else slots, "slot").drop("slot")


def build_index(rows: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """The index of rows(doc_id, row, norm, key): bucket, depth, key, text_sha256, n_bytes, keep, group_size; a file holds whole buckets."""
    entries = rows.groupBy("key", "norm").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    entries = entries.select("key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), "keep", "group_size")
    return written(placed(entries, slots, bits).repartition("bucket").sortWithinPartitions("bucket", "key"), "extendible-index")


def exact_dedup(documents: DataFrame, capacity: int = CAPACITY, row: str | None = None) -> DataFrame:
    """One row per row of documents(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256; and the column row, if one is named.

    Texts are equal when identical after lower-casing A-Z only; a null text is an empty one. Of equal texts the row with the
    largest doc_id stays; if several rows have it, that of the largest row, if row names a column of numbers that tell rows
    apart, else each of them (they are equal but for case). A null doc_id stays if its text has no other: with row, one of
    such rows, else only one that stands alone. Other columns are ignored; an empty table gives no rows.
    """
    rows = keyed(documents, row)
    salt = F.pmod(F.xxhash64("doc_id", "row", F.lit(7)), F.lit(SALTS)).cast("int")
    small = written(rows.select("doc_id", "row", "key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), salt.alias("salt")), "keyed-rows")
    keys = small.select("key").distinct()
    slots, bits = directory(keys, small.count(), capacity)
    index = build_index(rows, slots, bits)
    # Most texts have no copy and need no look-up; the others' entries stand in each salt.
    groups = index.where("group_size > 1").select("bucket", "key", "text_sha256", "n_bytes", "keep", "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = placed(small, slots, bits).drop("depth").join(groups, ["bucket", "key", "text_sha256", "n_bytes", "salt"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    kept = alone | F.col("keep").eqNullSafe(F.struct("doc_id", "row")) if row else keep.eqNullSafe(F.col("doc_id")) & (alone | F.col("doc_id").isNotNull())
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *([F.col("row").alias(row)] if row else []))
