"""Registered relational queries: keyed reads, joins, counts, orders and limits over items, chunks, facts and payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.plans.registry import query
from folioquery.sources.tables import table


@query("items_by_key", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (3, 5, 8, 13, 21)")
def keyed(spark, sf):
    return table(spark, sf, "documents", "doc_id", "source", "n_chars").where(F.col("doc_id").isin(3, 5, 8, 13, 21))


@query("items_with_first_line", "SELECT o_orderkey AS item_id, o_orderdate, l_partkey AS first_part FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1")
def first_chunk(spark, sf):
    """Every item with its first chunk, if it has one."""
    first = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").where("l_linenumber = 1")
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("item_id"), "o_orderdate", F.col("l_partkey").alias("first_part"))


@query("chunks_with_items", "SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey IN (1, 2, 3, 5, 8)")
def hydrate(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").where(F.col("l_partkey").isin(1, 2, 3, 5, 8))
    return lines.join(table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus")


@query("payments_with_items", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def with_items(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(table(spark, sf, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_paise"), "c_name")


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS items, max(o_orderdate) AS newest FROM orders GROUP BY 1")
def counts(spark, sf):
    return table(spark, sf, "orders", "o_orderstatus", "o_orderdate").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("items"), F.max("o_orderdate").alias("newest"))


@query("vector_signature", "SELECT count(*) AS vectors, coalesce(CAST(sum(vec_id) AS BIGINT), 0) AS id_sum, count(*) FILTER (label <> 3) AS other_version FROM embeddings")
def signature(spark, sf):
    """What tells whether cached vectors are out of date."""
    return table(spark, sf, "embeddings", "vec_id", "label").agg(F.count("*").alias("vectors"), F.coalesce(F.sum("vec_id"), F.lit(0)).alias("id_sum"), F.count_if(F.col("label") != 3).alias("other_version"))


@query("recent_items", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def recent(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(25)


@query("pending_work", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS turn FROM orders WHERE o_orderstatus = 'P' ORDER BY turn LIMIT 500")
def pending(spark, sf):
    """The next batch of work, newest first, in its order."""
    from pyspark.sql import Window

    batch = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)
    return batch.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("turn"))


@query("average_times", "SELECT event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY event_type")
def averages(spark, sf):
    return table(spark, sf, "events", "event_type", "value").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@query("duplicate_probe", "SELECT DISTINCT a.doc_id FROM documents a WHERE EXISTS (SELECT 1 FROM documents b WHERE coalesce(b.text, '') = coalesce(a.text, '') AND b.doc_id <> a.doc_id)")
def probe(spark, sf):
    """Items whose content another item has: by counts, which have partial sums."""
    docs = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("h"))
    twice = docs.groupBy("h").count().where("count > 1")
    return docs.join(twice, "h", "left_semi").select("doc_id")


@query("telugu_share", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{0C00}-\x{0C7F}]')) AS telugu, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS letters FROM documents")
def telugu(spark, sf):
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.regexp_count(text, F.lit(r"[\x{0C00}-\x{0C7F}]")).cast("long").alias("telugu"), F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("letters"))


@query("ocr_policy", r"WITH r AS (SELECT doc_id, text AS a, reverse(text) AS b, (doc_id % 100) / 100.0 AS conf, doc_id % 11 = 0 AS dropped FROM documents) SELECT doc_id, CASE WHEN (trim(coalesce(a, '')) = '' OR conf < 0.75 OR dropped) AND len(regexp_extract_all(coalesce(b, ''), '\p{Lu}')) >= 5 AND len(regexp_extract_all(coalesce(b, ''), '\p{Lu}')) >= 0.02 * len(regexp_extract_all(coalesce(b, ''), '\p{L}')) THEN 'second' ELSE 'first' END AS chosen FROM r")
def policy(spark, sf):
    """Which of two readings of an item is kept: the second, if the first is doubtful and the second looks like its script."""
    from folioquery.operators.reading import choose

    docs = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.col("text").alias("first"), F.reverse("text").alias("second"), ((F.col("doc_id") % 100) / 100.0).alias("confidence"), (F.col("doc_id") % 11 == 0).cast("int").alias("dropped_lines"))
    return choose(docs, script=r"\p{Lu}", least=5, share=0.02).select("doc_id", "chosen")


@query("item_detail", "SELECT o_orderkey AS item_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def detail(spark, sf):
    """An item with its chunks in order, put together."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return table(spark, sf, "orders", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("item_id"), F.array_join(F.transform("l", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"), F.size("l").alias("n"))
