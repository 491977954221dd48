"""Registered queries of the notification history, made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import ingest, notifications as N
from folioquery.plans.registry import query
from folioquery.sources.tables import table

NOW_MS = 1_706_500_000_000
SQL_ROWS = """
n AS (SELECT event_id AS id, 'app.' || event_type AS package, event_type AS app_label, 'User ' || user_id AS title,
  CASE WHEN event_id % 13 = 0 THEN 'Your OTP is ' || (100000 + event_id) WHEN event_id % 17 = 0 THEN '  spaced   out  ' ELSE event_type || ' of 100% on item_' || (event_id % 50) END AS text,
  {ms} AS posted_at, event_id % 19 = 0 AS ongoing, event_id % 23 = 0 AS group_summary, CASE event_id % 10 WHEN 0 THEN 'progress' WHEN 1 THEN 'msg' END AS category FROM {events})
"""
DUCK = "WITH " + SQL_ROWS.replace("{ms}", "epoch_us(ts) // 1000").replace("{events}", "events")
KEPT = DUCK + ", k AS (SELECT * REPLACE (trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text) FROM n WHERE NOT ongoing AND NOT group_summary AND coalesce(category, '') <> 'progress' AND package <> 'app.error' AND NOT (event_id_otp)) ".replace("event_id_otp", "id % 13 = 0")


def rows(spark, sf):
    return spark.sql("WITH " + SQL_ROWS.replace("{ms}", "unix_millis(CAST(ts AS TIMESTAMP))") + " SELECT * FROM n", events=table(spark, sf, "events"))


def history(spark, sf):
    return N.kept(rows(spark, sf), "app.error")


@query("notifications_kept", KEPT + "SELECT id, package, title, text, posted_at FROM k")
def kept(spark, sf):
    return history(spark, sf).select("id", "package", "title", "text", "posted_at")


@query("notifications_sensitive", DUCK + "SELECT id % 13 = 0 AS sensitive, count(*) AS n FROM n GROUP BY 1")
def sensitive(spark, sf):
    return rows(spark, sf).groupBy(N.sensitive(F.col("title"), F.col("text")).alias("sensitive")).agg(F.count("*").alias("n"))


@query("notifications_search", KEPT + "SELECT id, text, posted_at FROM k WHERE (text ILIKE '%100\\%%' ESCAPE '\\' OR title ILIKE '%100\\%%' ESCAPE '\\') AND (text ILIKE '%item\\_7%' ESCAPE '\\' OR title ILIKE '%item\\_7%' ESCAPE '\\') AND (text ILIKE '%purchase%' OR title ILIKE '%purchase%' OR app_label ILIKE '%purchase%') ORDER BY posted_at DESC, id DESC LIMIT 40")
def searched(spark, sf):
    return N.search(history(spark, sf), "100% Item_7 x PURCHASE").select("id", "text", "posted_at")


@query("notifications_like", KEPT + "SELECT id, contains(text, '100%') AS percent, contains(text, 'item_7') AS underline, contains(text, 'e\\') AS backslash FROM k")
def matched(spark, sf):
    """Terms whose signs would mean something in a pattern."""
    return history(spark, sf).select("id", *[N.holds("text", term).alias(name) for name, term in (("percent", "100%"), ("underline", "item_7"), ("backslash", "e\\"))])


@query("notifications_retained", KEPT + f"SELECT id, posted_at FROM k WHERE posted_at >= {NOW_MS} - 20 * 86400000 ORDER BY posted_at DESC, id DESC LIMIT 500")
def retained(spark, sf):
    return ingest.retain(history(spark, sf), NOW_MS, 20, 500).select("id", "posted_at")


@query("notifications_distinct", KEPT + "SELECT package, posted_at, title, text, min(id) AS id FROM k GROUP BY ALL")
def distinct(spark, sf):
    return history(spark, sf).groupBy("package", "posted_at", "title", "text").agg(F.min("id").alias("id"))
