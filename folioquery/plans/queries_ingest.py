"""Registered queries of ingestion, over documents as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.functions.ranks import upper_median
from folioquery.functions.text import clean_lines
from folioquery.operators import ingest as I
from folioquery.plans.registry import query
from folioquery.sources.tables import table

SQL_ITEMS = """
items AS (SELECT doc_id AS id, doc_id AS added_at, text, doc_id % 37 = 0 AS failed, sha256(coalesce(text, '')) AS content_hash FROM documents),
winners AS (SELECT content_hash, max(id) AS winner FROM items WHERE NOT failed GROUP BY content_hash),
statuses AS (SELECT id, content_hash, CASE WHEN failed THEN 'FAILED' WHEN winner <> id THEN 'DUPLICATE' WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 'NO_TEXT' ELSE 'INDEXED' END AS status FROM items LEFT JOIN winners USING (content_hash))
"""
SQL_SCAN = """
f AS (SELECT doc_id, 'doc/' || doc_id AS uri, doc_id AS added_at, n_chars AS size_bytes, doc_id * 10 AS modified_at, n_chars % 2000 AS width, 100 + doc_id % 900 AS height FROM documents),
existing AS (SELECT uri, modified_at, CASE WHEN doc_id % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes FROM f WHERE doc_id % 3 <> 0),
scanned AS (SELECT uri, modified_at, size_bytes FROM f WHERE doc_id % 7 <> 0)
"""


def items(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("added_at"), "text", (F.col("doc_id") % 37 == 0).alias("failed"))


def found(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "n_chars")
    return docs.selectExpr("doc_id", "concat('doc/', doc_id) AS uri", "doc_id AS added_at", "n_chars AS size_bytes", "doc_id * 10 AS modified_at", "n_chars % 2000 AS width", "100 + doc_id % 900 AS height")


@query("content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def hashes(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", I.content_hash(F.coalesce(F.col("text"), F.lit(""))).alias("content_hash"))


@query("ingest_statuses", "WITH " + SQL_ITEMS + "SELECT * FROM statuses")
def statuses(spark, sf):
    return I.statuses(items(spark, sf)).select("id", "content_hash", "status")


@query("ingest_status_counts", "WITH " + SQL_ITEMS + "SELECT status, count(*) AS items FROM statuses GROUP BY status")
def status_counts(spark, sf):
    return I.statuses(items(spark, sf)).groupBy("status").agg(F.count("*").alias("items"))


@query("clean_lines", r"SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\x0C\r\x{0085}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)")
def lines(spark, sf):
    rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", clean_lines(F.coalesce(F.col("text"), F.lit(""))).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("library_scan", "WITH " + SQL_SCAN + "SELECT uri, added_at, width, height FROM f WHERE least(width, height) >= 200 ORDER BY added_at DESC, uri DESC LIMIT 1000")
def scan(spark, sf):
    return I.scan(found(spark, sf)).select("uri", "added_at", "width", "height")


def sides(spark, sf):
    f = found(spark, sf)
    existing = f.where("doc_id % 3 <> 0").withColumn("size_bytes", F.when(F.col("doc_id") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return f.where("doc_id % 7 <> 0"), existing


SQL_RECONCILE = "WITH " + SQL_SCAN + ", c AS (SELECT coalesce(s.uri, e.uri) AS uri, CASE WHEN e.uri IS NULL THEN 'added' WHEN s.uri IS NULL THEN 'removed' WHEN s.modified_at <> e.modified_at OR s.size_bytes <> e.size_bytes THEN 'changed' ELSE 'same' END AS change FROM scanned s FULL JOIN existing e ON s.uri = e.uri) "


@query("reconcile", SQL_RECONCILE + "SELECT * FROM c")
def reconcile(spark, sf):
    return I.reconcile(*sides(spark, sf), complete=True)


@query("reconcile_partial_counts", SQL_RECONCILE + "SELECT change, count(*) AS items FROM c WHERE change <> 'removed' GROUP BY change")
def partial(spark, sf):
    return I.reconcile(*sides(spark, sf), complete=False).groupBy("change").agg(F.count("*").alias("items"))


@query("insert_ignore", "WITH " + SQL_SCAN + "SELECT uri, modified_at, size_bytes FROM existing UNION ALL SELECT * FROM scanned WHERE uri NOT IN (SELECT uri FROM existing)")
def ignore(spark, sf):
    new, old = sides(spark, sf)
    columns = ["uri", "modified_at", "size_bytes"]
    return I.insert_ignore(old.select(*columns), new.select(*columns), ["uri"])


@query("upsert", "WITH " + SQL_SCAN + "SELECT * FROM scanned UNION ALL SELECT uri, modified_at, size_bytes FROM existing WHERE uri NOT IN (SELECT uri FROM scanned)")
def upsert(spark, sf):
    new, old = sides(spark, sf)
    columns = ["uri", "modified_at", "size_bytes"]
    return I.upsert(old.select(*columns), new.select(*columns), ["uri"])


@query("cascade_delete", "SELECT o_orderkey AS id, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def cascade(spark, sf):
    removed = table(spark, sf, "orders", "o_orderkey").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    tables = {"lines": table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")}
    return I.cascade_delete(tables, removed, {"lines": "l_orderkey"})["lines"].join(table(spark, sf, "orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), "l_linenumber")


@query("replace_payments", "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'EXCLUDE' END AS decision FROM orders")
def replace(spark, sf):
    old = table(spark, sf, "orders", "o_orderkey").selectExpr("o_orderkey AS item_id", "'old' AS source", "CASE WHEN o_orderkey % 5 = 0 THEN 'EXCLUDE' END AS decision")
    new = old.where("item_id % 2 = 0").select("item_id", F.lit("new").alias("source"), F.lit(None).cast("string").alias("decision"))
    return I.replace_payments(old, new)


@query("text_lengths", "SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, quantile_disc(n_chars, 0.0) AS least, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median FROM documents GROUP BY source")
def lengths(spark, sf):
    rows = table(spark, sf, "documents", "source", "text", "n_chars")
    sums = rows.groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.min("n_chars").alias("least"))
    return sums.join(upper_median(rows, ["source"], "n_chars", "upper_median"), "source", "left")


def sql_scan_result(access, most):
    """What a scan of at most so many files tells, in SQL; those that were there are two thirds of the files, some with another size, and some that are gone."""
    return f"""WITH {SQL_SCAN}, was AS (SELECT * FROM existing UNION ALL SELECT 'gone/' || doc_id, 0, 0 FROM f WHERE doc_id % 11 = 0),
t AS (SELECT uri, added_at, modified_at, size_bytes FROM f WHERE least(width, height) >= 200 ORDER BY added_at DESC, uri DESC LIMIT {most}),
s AS (SELECT count(*) AS seen, min(added_at) AS last FROM t),
c AS (SELECT CASE WHEN w.uri IS NULL THEN 'added' WHEN t.uri IS NULL THEN 'removed' WHEN w.modified_at <> t.modified_at OR w.size_bytes <> t.size_bytes THEN 'changed' END AS change FROM t FULL JOIN was w USING (uri))
SELECT '{access}' AS access, {most} AS most, seen, (SELECT count(*) FROM c WHERE change = 'added') AS added, (SELECT count(*) FROM c WHERE change = 'changed') AS changed,
  CASE WHEN '{access}' = 'FULL' AND seen < {most} THEN (SELECT count(*) FROM c WHERE change = 'removed') ELSE 0 END AS removed, (SELECT count(*) FROM f WHERE least(width, height) < 200 AND (seen < {most} OR added_at > last)) AS skipped_small FROM s"""


SCANS = [("FULL", 1_000_000), ("FULL", 40), ("PARTIAL", 1_000_000)]


@query("scan_result", " UNION ALL ".join(f"SELECT * FROM ({sql_scan_result(a, n)})" for a, n in SCANS) + " UNION ALL SELECT 'NONE', 40, 0, 0, 0, 0, 0 FROM (SELECT count(*) FROM documents)")
def scans(spark, sf):
    """Scans with full access, with few files taken, with access to some of them, and with none."""
    files, (_, was) = found(spark, sf), sides(spark, sf)
    gone = files.where("doc_id % 11 = 0").selectExpr("concat('gone/', doc_id) AS uri", "0 AS modified_at", "0 AS size_bytes")
    existing = was.select("uri", "modified_at", "size_bytes").unionByName(gone)
    out = None
    for access, most in [*SCANS, ("NONE", 40)]:
        one = I.scan_result(files, existing, access, most).select(F.lit(access).alias("access"), F.lit(most).alias("most"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("indexed_copies", "WITH " + SQL_ITEMS + "SELECT a.id, (SELECT count(*) FROM statuses b WHERE b.content_hash = a.content_hash AND b.id <> a.id AND b.status IN ('INDEXED', 'NO_TEXT')) AS copies FROM statuses a")
def copies(spark, sf):
    """How many worked-on items of the same content each item has beside it."""
    return I.indexed_copies(I.statuses(items(spark, sf)))
