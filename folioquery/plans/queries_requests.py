"""Registered queries of requests from outside, settings screens and plans, over columns of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import facts as X
from folioquery.operators import names as O
from folioquery.operators import requests as Q
from folioquery.operators import routing, scalars
from folioquery.plans.queries_facts import texts
from folioquery.plans.registry import query
from folioquery.sources.tables import table

SQL_CLEAN = "CASE WHEN t = '' THEN NULL WHEN length(t) <= 300 THEN t WHEN contains(substr(t, 1, 300), ' ') THEN trim(regexp_replace(substr(t, 1, 300), ' [^ ]*$', '')) ELSE substr(t, 1, 300) END"


@query("incoming_requests", f"WITH r AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, {SQL_CLEAN} AS t FROM r) SELECT doc_id AS request_id, CASE WHEN doc_id % 6 = 0 THEN 'SEARCH' WHEN doc_id % 6 = 1 AND t IS NOT NULL THEN 'TEXT' WHEN doc_id % 6 = 2 THEN 'IMAGE' WHEN doc_id % 6 IN (3, 4) AND t IS NOT NULL THEN 'TEXT' END AS kind, CASE WHEN doc_id % 6 IN (1, 3, 4) THEN t WHEN doc_id % 6 = 2 THEN 'content://' || doc_id END AS value FROM c")
def incoming(spark, sf):
    """Requests of six forms, the last of them of a type that isn't taken."""
    case = lambda *values: "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values) if v) + " END"
    action = case(f"'{Q.OPEN_SEARCH}'", f"'{Q.PROCESS_TEXT}'", *[f"'{Q.SEND}'"] * 4)
    kind = case(None, None, "'image/png'", "'text/plain'", None, "'video/mp4'")
    rows = table(spark, sf, "documents", "doc_id", "text").selectExpr("doc_id AS request_id", f"{action} AS action", f"{kind} AS type", "text AS process_text", "text AS send_text", "concat('content://', doc_id) AS stream_uri")
    return Q.parse(rows)


def settings_catalogue(spark):
    return spark.createDataFrame(Q.SETTINGS, "label string, action string, names array<string>")


def settings_typed(spark, sf):
    """For each customer a name of a settings screen: as it is, wrapped in other words, with a letter lacking, or with words that aren't a name."""
    names = [name for _, _, known in Q.SETTINGS for name in known]
    name = F.element_at(F.array(*map(F.lit, names)), (1 + F.col("c_custkey") % len(names)).cast("int"))
    k = F.col("c_custkey") / 7 % 4
    text = F.when(k < 1, name).when(k < 2, F.concat(F.lit("open "), name, F.lit(" settings"))).when(k < 3, F.concat(F.substring(name, 1, 2), F.expr("substring(name, 4)"))).otherwise(F.concat(name, F.lit(" bill of march")))
    return table(spark, sf, "customer", "c_custkey").withColumn("name", name).select(F.col("c_custkey").alias("query_id"), text.alias("text"))


@query("settings_search")
def settings(spark, sf):
    """Settings screens for typed names, as they are, wrapped in other words, and misspelt."""
    return O.search_settings(settings_catalogue(spark), settings_typed(spark, sf)).select("query_id", "label", F.round("score", 6).alias("score"), "rank")


SQL_CLOCK = "(CASE WHEN (o_orderkey % 24) % 12 = 0 THEN 12 ELSE (o_orderkey % 24) % 12 END) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 24 < 12 THEN ' AM' ELSE ' PM' END || ' (' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ')'"


@query("command_plans", f"SELECT o_orderkey AS query_id, 'ALARM' AS action, 'Set an alarm for ' || {SQL_CLOCK} || '?' AS question, (o_orderkey % 24) || ':' || (o_custkey % 60) AS target FROM orders UNION ALL SELECT o_orderkey, 'TIMER', 'Start a timer for ' || (1 + o_custkey % 59) || ' min?', CAST(60 * (1 + o_custkey % 59) AS VARCHAR) FROM orders")
def commands(spark, sf):
    """Typed alarms and timers of each order, read and planned."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    alarm = "concat('set alarm ', CASE WHEN (o_orderkey % 24) % 12 = 0 THEN 12 ELSE (o_orderkey % 24) % 12 END, ':', lpad(CAST(o_custkey % 60 AS STRING), 2, '0'), CASE WHEN o_orderkey % 24 < 12 THEN ' am' ELSE ' pm' END)"
    typed = o.selectExpr("o_orderkey AS query_id", f"{alarm} AS text").unionByName(o.selectExpr("o_orderkey AS query_id", "concat('timer ', 1 + o_custkey % 59, ' min') AS text"))
    return Q.command_plans(scalars.commands(typed))


@query("contact_plans", "SELECT s_suppkey AS id, 'CALL' AS action, 'Call ' || s_name || '?' AS question, '+9198765' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS target FROM supplier")
def contacts(spark, sf):
    rows = table(spark, sf, "supplier", "s_suppkey", "s_name").selectExpr("s_suppkey AS id", "s_name AS name", "concat('+91 98765-', lpad(CAST(s_suppkey AS STRING), 5, '0')) AS number")
    return Q.contact_plans(rows)


@query("web_plans", "SELECT c_custkey AS query_id, 'WEB' AS action, 'Search the web?' AS question, c_name AS target FROM customer WHERE c_custkey % 3 <> 0")
def web(spark, sf):
    return Q.web_plans(table(spark, sf, "customer", "c_custkey", "c_name").selectExpr("c_custkey AS query_id", "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS text"))


@query("fact_subjects", "SELECT o_orderkey AS fact_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Bill ' || o_custkey || ': Due date' WHEN o_orderkey % 3 = 1 THEN 'Due date' ELSE 'Date from img' || o_custkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Bill ' || o_custkey || ' - Due date: ' WHEN o_orderkey % 3 = 1 THEN 'Due date: ' ELSE 'Date: ' END || strftime(o_orderdate, '%Y-%m-%d') AS head, o_custkey % 2 = 0 AS low_confidence FROM orders")
def subjects(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").selectExpr("o_orderkey AS fact_id", "'DATE' AS kind", "date_format(o_orderdate, 'yyyy-MM-dd') AS value", "CASE WHEN o_orderkey % 3 < 2 THEN 'Due date: -' END AS label", "'' AS raw", "CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 0.9 END AS confidence", "CASE WHEN o_orderkey % 3 = 0 THEN concat(' Bill ', o_custkey, ' ') ELSE '' END AS item_title", "concat('img', o_custkey) AS source")
    return Q.subjects(rows).select("fact_id", "title", "head", "low_confidence")


@query("item_facts", "SELECT o_orderkey AS item_id, true AS has_amount, 1 AS dates, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def detail(spark, sf):
    """Each item's text with the facts read from it: whether it has an amount, how many dates, and the day."""
    own = texts(spark, sf)
    of = lambda kind: F.col("kind") == kind
    read = X.facts(own).groupBy("item_id").agg((F.count_if(of("AMOUNT")) > 0).alias("has_amount"), F.count_if(of("DATE")).alias("dates"), F.substring(F.min(F.when(of("DATE"), F.col("value"))), 1, 10).alias("day"))
    return own.select("item_id").join(read, "item_id", "left")


#: What is written below a document: by kind the line, and the value that it holds.
PLANTED = {
    "AMOUNT": ("'Amount: ₹' || (1000 + doc_id)", "CAST(1000 + doc_id AS {text})"), "DATE": ("'Due date: 15 Sep ' || (2001 + doc_id % 90)", "(2001 + doc_id % 90) || '-09-15'"),
    "PHONE": ("'Mobile: 98765 ' || lpad(CAST(doc_id % 100000 AS {text}), 5, '0')", "'+9198765' || lpad(CAST(doc_id % 100000 AS {text}), 5, '0')"), "ADDRESS": ("'Address: Plot ' || doc_id || ', Main Road'", "'Plot ' || doc_id || ', Main Road'"),
}


def planted(spark, sf):
    """(texts, facts): whole documents with four lines below each, and what these hold."""
    d = table(spark, sf, "documents", "doc_id", "text")
    lines = " || chr(10) || ".join(line for line, _ in PLANTED.values()).format(text="STRING")
    values = ", ".join(f"'{kind}', {value.format(text='STRING')}" for kind, (_, value) in PLANTED.items())
    return d.selectExpr("doc_id AS item_id", f"coalesce(text, '') || chr(10) || {lines} AS text"), d.selectExpr("doc_id AS item_id", f"stack({len(PLANTED)}, {values}) AS (kind, value)")


@query("facts_of_documents", " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS planted, count(*) AS found, count(DISTINCT {value.format(text='VARCHAR')}) AS distinct_values FROM documents" for kind, (_, value) in PLANTED.items()))
def facts_of_documents(spark, sf):
    """Amounts, dates, phone numbers and addresses below whole documents: a row for each kind, with how many were written and are found."""
    texts, written = planted(spark, sf)
    read = X.facts(texts).select("item_id", "kind", "value").distinct().withColumn("hit", F.lit(1))
    found = written.join(read, ["item_id", "kind", "value"], "left")
    return found.groupBy("kind").agg(F.count("*").alias("planted"), F.count("hit").alias("found"), F.countDistinct(F.when(F.col("hit") == 1, F.col("value"))).alias("distinct_values"))


@query("phones_and_addresses", "SELECT s_suppkey AS item_id, 'PHONE' AS kind, '+9198765' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS value FROM supplier UNION ALL SELECT s_suppkey, 'ADDRESS', 'Plot ' || s_nationkey || ', Main Road, Hyderabad 500' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') FROM supplier")
def contacts_read(spark, sf):
    """Phone numbers and addresses read from cards made of suppliers."""
    cards = table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey").selectExpr("s_suppkey AS item_id", "concat_ws('\n', 'Visiting card', concat('Mobile: 98765 ', lpad(CAST(s_suppkey % 100000 AS STRING), 5, '0')), concat('Address: Plot ', s_nationkey), 'Main Road', concat('Hyderabad 500', lpad(CAST(s_nationkey AS STRING), 3, '0'))) AS text")
    return X.facts(cards).where("kind IN ('PHONE', 'ADDRESS')").select("item_id", "kind", "value")


SQL_MONTHS = "(['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'])[month(o_orderdate)]"


@query("spending_asked", "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(month(o_orderdate) AS INT) END AS month_number, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 2000 + CAST(o_custkey % 90 AS INT) END AS year, CASE o_orderkey % 3 WHEN 1 THEN 'THIS_MONTH' WHEN 2 THEN 'LAST_MONTH' END AS relative FROM orders")
def spending(spark, sf):
    """Questions about spending made of the orders' months."""
    typed = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").selectExpr("o_orderkey AS query_id", "CASE o_orderkey % 3 WHEN 0 THEN concat('how much did I spend in ', date_format(o_orderdate, 'MMMM'), CASE WHEN o_custkey % 2 = 0 THEN concat(' ', 2000 + o_custkey % 90) ELSE '' END) WHEN 1 THEN 'spent this month' ELSE 'what did I spend last month' END AS text")
    return routing.spending(typed)


@query("routes", "SELECT o_orderkey AS query_id, CASE o_orderkey % 6 WHEN 0 THEN 'CALCULATOR' WHEN 1 THEN 'SPENDING,FILE_SEARCH' WHEN 2 THEN 'QUESTION,FILE_SEARCH' WHEN 3 THEN 'COMMAND,FILE_SEARCH' WHEN 4 THEN 'FILE_SEARCH' ELSE '' END AS kinds FROM orders")
def routes(spark, sf):
    """Where texts made of the orders go."""
    typed = table(spark, sf, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey AS query_id", "CASE o_orderkey % 6 WHEN 0 THEN concat(o_custkey, ' + ', o_orderkey) WHEN 1 THEN 'how much did I spend last month' WHEN 2 THEN concat('when is the due date of bill ', o_custkey, '?') WHEN 3 THEN concat('timer ', 1 + o_custkey % 59, ' min') WHEN 4 THEN 'beach photos' ELSE '  ' END AS text")
    return routing.route(typed, "2026-10-05").select("query_id", "kinds")
