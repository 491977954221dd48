"""Registered queries of routing and of plans for facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import routing
from folioquery.plans.registry import query
from folioquery.sources.tables import table

#: What is typed by the customer's number by 7, and what it may be.
TYPED = [("concat('2+', c_custkey)", "CALCULATOR"), ("'how much did I spend in september 2026'", "SPENDING,FILE_SEARCH"), ("concat('when is bill ', c_custkey, ' due')", "QUESTION,FILE_SEARCH"), ("'set alarm 7'", "COMMAND,FILE_SEARCH"), ("concat('open ', lower(n_name))", "APP,FILE_SEARCH"), ("concat('beach photos ', c_custkey)", "FILE_SEARCH"), ("'   '", "")]


@query("route", "SELECT c_custkey AS query_id, CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{kinds}'" for k, (_, kinds) in enumerate(TYPED)) + " END AS kinds FROM customer")
def routed(spark, sf):
    nations = table(spark, sf, "nation", "n_nationkey", "n_name")
    typed = table(spark, sf, "customer", "c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS query_id", "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN {text}" for k, (text, _) in enumerate(TYPED)) + " END AS text")
    apps = nations.selectExpr("n_name AS label", "concat('org.nation.', lower(n_name)) AS package", "CAST(n_nationkey AS STRING) AS component")
    return routing.route(typed, "2026-10-05", apps=apps).select("query_id", "kinds")


@query("spending_queries", "SELECT o_orderkey AS query_id, CAST(CASE WHEN o_orderkey % 3 < 2 THEN month(o_orderdate) END AS INTEGER) AS month_number, CAST(CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) + 30 END AS INTEGER) AS year, CASE WHEN o_orderkey % 3 = 2 THEN 'THIS_MONTH' END AS relative FROM orders")
def spending(spark, sf):
    """Spending asked for by month and year, by month alone, and by this month."""
    typed = table(spark, sf, "orders", "o_orderkey", "o_orderdate").selectExpr("o_orderkey AS query_id", "CASE o_orderkey % 3 WHEN 0 THEN concat(date_format(o_orderdate, \"'how much did I spend in 'MMMM \"), year(o_orderdate) + 30) WHEN 1 THEN date_format(o_orderdate, \"'spent in 'MMMM\") ELSE 'spent this month' END AS text")
    return routing.spending(typed)


@query("calendar_plans", "SELECT o_orderkey AS fact_id, 'CALENDAR' AS action, strftime(o_orderdate, '%Y-%m-%d') || '/all-day' AS target, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'in the past' ELSE '' END AS note FROM orders UNION ALL SELECT o_orderkey, 'SHARE', strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'in the past' ELSE '' END FROM orders")
def plans(spark, sf):
    facts = table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("fact_id"), F.lit("DATE").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), F.lit(0.9).alias("confidence"))
    return routing.actions(facts, "1998-01-01").select("fact_id", "action", "target", "note")


SQL_EVENT = "SELECT o_orderkey AS fact_id, o_orderkey % 3 <> 0 AS all_day, epoch_ms(CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) + CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 24) * 3600000 + (o_orderkey % 60) * 60000 - 19800000 ELSE 0 END AS begin_ms FROM orders WHERE o_orderkey % 7 <> 0"


@query("calendar_times", f"SELECT *, begin_ms + CASE WHEN all_day THEN 86400000 ELSE 3600000 END AS end_ms FROM ({SQL_EVENT})")
def times(spark, sf):
    """Begin and end of whole days, and of hours in a zone ahead of UTC; what is no day has none."""
    facts = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").selectExpr("o_orderkey AS fact_id", "CASE WHEN o_orderkey % 7 = 0 THEN 'someday' WHEN o_orderkey % 3 = 0 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', lpad(CAST(o_custkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS value")
    return routing.calendar_times(facts, "1998-01-01", "Asia/Kolkata")
