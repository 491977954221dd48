"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. Each shard of the tree has a draw, -ln(u) / weight, where u
is a hash of the doc_id and the shard's number; the draw of a rack or region is the least one in it, which is by itself a
draw with the sum of its weights. At each level the row takes the child of the least draw. So a change of a weight, or a
shard more, moves rows only between the subtree that changes and the others, and of those only into (or out of) the shard
that changes, whatever the number of shards. Shard s stands in rack s // RACK of region s // (RACK * RACKS).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm.shared import written

SHARDS, RACK, RACKS = 24, 4, 2
#: Rows of a shard are numbered in so many blocks; a block's first slot is the number of rows in those before it.
BLOCKS = 1024


def tree(shards: int, weights: dict[int, float] | None = None) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight"""
    out: dict = {}
    for s in range(shards):
        out.setdefault(s // (RACK * RACKS), {}).setdefault(s // RACK, {})[s] = float((weights or {}).get(s, 1.0))
    return out


def draw(shard: int, weight: float):
    """(draw, shard) of one shard for the row's doc_id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(f"shard/{shard}")), 11)
    return F.struct((-F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(weight)).alias("draw"), F.lit(shard).alias("shard"))


def descend(node: dict):
    """(draw, shard) of the shard that a row reaches from a node of the tree."""
    children = [descend(x) if isinstance(x, dict) else draw(k, x) for k, x in node.items()]
    return F.least(*children) if len(children) > 1 else children[0]


def shard_of(nodes: dict[int, dict[int, dict[int, float]]], df: DataFrame, name: str) -> DataFrame:
    """df with the shard that each row's doc_id (null counts as a value of its own) reaches in the tree."""
    return df.withColumn(name, descend(nodes)["shard"].cast("int"))


def shard(documents: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """Puts all documents(doc_id, text, ...) into shards 0 to shards - 1 by the law `key`.

    Returns doc_id, size (UTF-8 bytes of the text, none if null, plus 8), text_crc32, law, shard, slot (gapless from 0 in a
    shard), grown_shard (with one more shard of weight 1). Rows that repeat a doc_id share its shard and get slots of their
    own; null doc_ids share one shard. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = shard_of(tree(shards, weights), rows, "shard")
    rows = shard_of(tree(shards + 1, weights), rows, "grown_shard")
    # Rows of one doc_id read by different tasks go to different blocks.
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id"), F.spark_partition_id()), F.lit(BLOCKS)).cast("int"))
    rows = written(rows, "sharded")
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    slotted = rows.withColumn("place", place).join(F.broadcast(offsets), ["shard", "block"])  # shards x BLOCKS rows at most
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
