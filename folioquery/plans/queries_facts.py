"""Registered queries of facts and payments, over texts made of orders so that what they hold is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import facts as X
from folioquery.operators import reminders
from folioquery.plans.registry import query
from folioquery.sources.tables import table

NAME = "'Shop ' || translate(CAST(o_custkey AS STRING), '0123456789', 'abcdefghij')"


def texts(spark, sf, once=False):
    """Payment screens in three layouts; of each tenth the payment failed, of each eleventh it was received. once: one screen for a key."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    orders = orders.dropDuplicates(["o_orderkey"]) if once else orders
    rupees = "format_number(o_totalprice, 2)"
    name = NAME.replace("||", "||")
    cue = "CASE WHEN o_orderkey % 10 = 0 THEN 'Payment failed' ELSE 'Payment successful' END"
    to = "CASE WHEN o_orderkey % 11 = 0 THEN 'Received from' ELSE 'Paid to' END"
    a = f"concat_ws('\n', 'PhonePe', {cue}, concat('₹', {rupees}), {to}, {name}, concat('UTR: ', 100000000000 + o_orderkey), date_format(o_orderdate, 'd MMM yyyy, h:mm a'))"
    b = f"concat_ws('\n', 'Google Pay', concat({to}, ' ', {name}), concat('Amount: Rs ', {rupees}), {cue}, 'UPI transaction ID', CAST(100000000000 + o_orderkey AS STRING), date_format(o_orderdate, 'dd/MM/yyyy HH:mm'))"
    c = f"concat_ws('\n', 'BHIM UPI', {cue}, concat({to}, ': ', {name}, ' (c', o_custkey, '@okbank)'), concat('Date: ', date_format(o_orderdate, 'MMMM d, yyyy')), concat('INR ', {rupees}), 'Cashback ₹5')"
    return orders.selectExpr("o_orderkey AS item_id", f"CASE o_orderkey % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END AS text")


SQL_NAME = "'Shop ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'abcdefghij')"


@query("read_payments", f"SELECT o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'PhonePe' WHEN 1 THEN 'Google Pay' ELSE 'BHIM' END AS app, CASE WHEN o_orderkey % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS outcome, CASE WHEN o_orderkey % 11 = 0 THEN 'RECEIVED' ELSE 'PAID' END AS direction, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise, {SQL_NAME} AS payee, CASE WHEN o_orderkey % 3 = 2 THEN 'c' || o_custkey || '@okbank' END AS upi_id, strftime(o_orderdate, '%Y-%m-%d') AS paid_date, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%H:%M') END AS paid_time, CASE WHEN o_orderkey % 3 < 2 THEN CAST(100000000000 + o_orderkey AS VARCHAR) END AS reference FROM orders")
def payments(spark, sf):
    return X.payments(texts(spark, sf)).select("item_id", "app", "outcome", "direction", "amount_paise", "payee", "upi_id", "paid_date", "paid_time", "reference")


@query("extract_dates", "SELECT o_orderkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, 'T%H:%M') ELSE '' END AS value, CASE o_orderkey % 3 WHEN 1 THEN CASE WHEN month(o_orderdate) > 12 THEN 0.6 ELSE 0.85 END ELSE 0.9 END AS confidence FROM orders")
def dates(spark, sf):
    return X.facts(texts(spark, sf)).where("kind = 'DATE'").select("item_id", "value", "confidence")


SQL_DUE = "d AS (SELECT o_orderkey AS fact_id, o_custkey AS item_id, 'item ' || o_custkey AS item_name, CASE o_orderkey % 4 WHEN 0 THEN 'Due date' WHEN 1 THEN 'Valid till:' WHEN 2 THEN 'Issued on' END AS label, CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '--%m-%d') WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders)"


@query("reminders", "WITH " + SQL_DUE + ", r AS (SELECT *, value || '|' || lower(rtrim(label, ':')) AS key, date_diff('day', DATE '1997-02-01', TRY_CAST(value AS DATE)) AS days_away FROM d WHERE label IN ('Due date', 'Valid till:') AND NOT starts_with(value, '--') AND value NOT LIKE '%T%'), k AS (SELECT * FROM r WHERE days_away BETWEEN 0 AND 60 QUALIFY row_number() OVER (PARTITION BY key ORDER BY fact_id) = 1) SELECT key, fact_id, item_name, days_away FROM k ORDER BY days_away, item_name, fact_id LIMIT 5")
def due(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    rows = o.selectExpr("o_orderkey AS fact_id", "o_custkey AS item_id", "concat('item ', o_custkey) AS item_name", "CASE o_orderkey % 4 WHEN 0 THEN 'Due date' WHEN 1 THEN 'Valid till:' WHEN 2 THEN 'Issued on' END AS label", "CASE WHEN o_orderkey % 9 = 0 THEN date_format(o_orderdate, '--MM-dd') WHEN o_orderkey % 7 = 0 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm\") ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS value")
    return reminders.suggest(rows, "1997-02-01").select("key", "fact_id", "item_name", "days_away")


SQL_CANDIDATES = "SELECT o_orderkey AS fact_id, o_custkey AS item_id, c_name AS item_name, CASE o_orderkey % 4 WHEN 0 THEN 'Due date' WHEN 1 THEN 'Valid till:' WHEN 2 THEN 'Issued on' END AS label, CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '--%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 5 <> 0 AND o_orderkey % 3 <> 1"


@query("deadline_candidates", f"SELECT * FROM ({SQL_CANDIDATES}) WHERE label IS NOT NULL AND NOT starts_with(value, '--')")
def deadlines(spark, sf):
    """Labelled dates with a year, of items that are indexed; other kinds of facts stand between them."""
    facts = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").selectExpr("o_orderkey AS fact_id", "o_custkey AS item_id", "CASE WHEN o_orderkey % 3 = 1 THEN 'PHONE' ELSE 'DATE' END AS kind", "CASE o_orderkey % 4 WHEN 0 THEN 'Due date' WHEN 1 THEN 'Valid till:' WHEN 2 THEN 'Issued on' END AS label", "CASE WHEN o_orderkey % 9 = 0 THEN date_format(o_orderdate, '--MM-dd') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS value")
    items = table(spark, sf, "customer", "c_custkey", "c_name").selectExpr("c_custkey AS item_id", "c_name AS item_name", "CASE WHEN c_custkey % 5 = 0 THEN 'FAILED' ELSE 'INDEXED' END AS status")
    return reminders.candidates(facts, items)
