"""Registered queries of the ledger, over payments made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import ledger as L
from folioquery.plans.registry import query
from folioquery.sources.tables import table

TODAY = "1998-06-15"
SQL_PAYMENTS = """
p0 AS (SELECT o.*, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey),
p1 AS (SELECT o_orderkey AS id, o_orderkey AS item_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'PhonePe' WHEN 1 THEN 'Paytm' WHEN 2 THEN 'BHIM' END AS app,
  CASE WHEN o_orderkey % 17 = 0 THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'SUCCESS' END AS outcome,
  CASE WHEN o_orderkey % 11 = 0 THEN 'RECEIVED' ELSE 'PAID' END AS direction,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_paise,
  CASE o_orderkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.45 END AS amount_confidence,
  CASE WHEN o_orderkey % 19 <> 0 THEN c_name END AS payee,
  CASE WHEN o_orderkey % 7 = 0 THEN 'c' || o_custkey || '@okbank' END AS upi_id,
  CASE WHEN o_orderkey % 23 <> 0 THEN {day} END AS paid_date,
  CASE WHEN o_orderkey % 2 = 0 THEN '1' || (o_orderkey % 10) || ':05' END AS paid_time,
  CASE WHEN o_orderkey % 5 < 3 THEN 'UTR' || CAST(floor(o_orderkey / 40) AS BIGINT) || (o_orderkey % 5) END AS reference,
  CASE WHEN o_orderkey % 29 = 0 THEN 'INCLUDE' WHEN o_orderkey % 31 = 0 THEN 'EXCLUDE' END AS decision
  FROM p0),
payments AS (SELECT *, CASE WHEN amount_paise IS NULL AND paid_date IS NULL THEN 'amount not read, date not read' WHEN amount_paise IS NULL THEN 'amount not read' WHEN paid_date IS NULL THEN 'date not read' END AS problem FROM p1)
"""
DUCK_PAYMENTS = SQL_PAYMENTS.replace("{day}", "strftime(o_orderdate, '%Y-%m-%d')")
KEY = "nullif(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}@]+', ' ', 'g')), '')"
SQL_LEDGER = "WITH " + DUCK_PAYMENTS + f""",
l1 AS (SELECT *, CASE WHEN problem IS NOT NULL OR amount_paise IS NULL OR paid_date IS NULL THEN 'UNREADABLE' WHEN outcome <> 'SUCCESS' OR direction <> 'PAID' THEN 'NOT_SPENDING' END AS f, {KEY.format(x="coalesce(payee, upi_id)")} AS pk FROM payments),
l2 AS (SELECT *, CASE WHEN f IS NULL THEN coalesce('ref:' || reference, 'ts:' || amount_paise || '|' || pk || '|' || paid_date || '|' || paid_time) END AS k FROM l1),
l3 AS (SELECT *, CASE WHEN k IS NULL THEN id ELSE first_value(id) OVER w END AS of, CASE WHEN k IS NULL THEN amount_paise ELSE first_value(amount_paise) OVER w END AS oa FROM l2
  WINDOW w AS (PARTITION BY k ORDER BY (coalesce(decision, '') = 'INCLUDE') DESC, amount_confidence DESC, id)),
ledger AS (SELECT *, CASE WHEN f IS NOT NULL THEN f WHEN of <> id THEN 'DUPLICATE' WHEN decision = 'EXCLUDE' THEN 'EXCLUDED' WHEN decision = 'INCLUDE' OR amount_confidence >= 0.6 THEN 'COUNTED' ELSE 'NEEDS_CHECK' END AS bucket FROM l3),
counted AS (SELECT *, substr(paid_date, 1, 7) AS month, coalesce(payee, upi_id, 'Unknown payee') AS pname FROM ledger WHERE bucket = 'COUNTED'),
totals AS (SELECT month, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS payments FROM counted GROUP BY month)
"""


def payments(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer", "c_custkey", "c_name")
    # {orders} and {customer} are DataFrames here, tables for DuckDB.
    return spark.sql("WITH " + SQL_PAYMENTS.replace("{day}", "date_format(o_orderdate, 'yyyy-MM-dd')").replace("FROM orders o", "FROM {orders} o").replace("JOIN customer c", "JOIN {customer} c") + " SELECT * FROM payments", orders=orders, customer=customer)


def ledger(spark, sf):
    return L.buckets(payments(spark, sf))


@query("ledger_buckets", SQL_LEDGER + "SELECT id, bucket, CASE WHEN bucket = 'DUPLICATE' THEN of END AS duplicate_of, CASE WHEN bucket = 'DUPLICATE' THEN amount_paise <> oa END AS amounts_differ FROM ledger")
def buckets(spark, sf):
    return ledger(spark, sf).select("id", "bucket", "duplicate_of", "amounts_differ")


@query("ledger_bucket_counts", SQL_LEDGER + "SELECT bucket, count(*) AS payments, CAST(sum(amount_paise) AS BIGINT) AS total_paise FROM ledger GROUP BY bucket")
def bucket_counts(spark, sf):
    return ledger(spark, sf).groupBy("bucket").agg(F.count("*").alias("payments"), F.sum("amount_paise").alias("total_paise"))


@query("ledger_months", SQL_LEDGER + "SELECT * FROM totals")
def months(spark, sf):
    return L.month_totals(ledger(spark, sf))


@query("ledger_payees", SQL_LEDGER + f"SELECT arg_max(pname, (paid_date, coalesce(paid_time, ''), -id)) AS name, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS payments FROM counted GROUP BY {KEY.format(x='pname')}")
def payees(spark, sf):
    return L.payee_totals(ledger(spark, sf))


@query("ledger_top_payees_of_month", SQL_LEDGER + f"SELECT * FROM (SELECT arg_max(pname, (paid_date, coalesce(paid_time, ''), -id)) AS name, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS payments FROM counted WHERE month = '1997-03' GROUP BY {KEY.format(x='pname')}) ORDER BY total_paise DESC, name LIMIT 5")
def top_payees(spark, sf):
    return L.payee_totals(ledger(spark, sf), "1997-03").orderBy(F.desc("total_paise"), "name").limit(5)


@query("ledger_spending_answer", SQL_LEDGER + "SELECT CAST(coalesce(sum(amount_paise) FILTER (bucket = 'COUNTED' AND substr(paid_date, 1, 7) = '1997-03'), 0) AS BIGINT) AS total_paise, count(*) FILTER (bucket = 'COUNTED' AND substr(paid_date, 1, 7) = '1997-03') AS payments, count(*) FILTER (bucket = 'NEEDS_CHECK' AND substr(paid_date, 1, 7) = '1997-03') AS needs_check, count(*) FILTER (bucket = 'UNREADABLE') AS unreadable FROM ledger")
def answer(spark, sf):
    return L.spending_answer(ledger(spark, sf), "1997-03")


@query("ledger_month_spine", SQL_LEDGER + ", s AS (SELECT strftime(unnest(generate_series(greatest(CAST(min(month) || '-01' AS DATE), CAST(CAST(max(month) || '-01' AS DATE) - INTERVAL 11 MONTH AS DATE)), CAST(max(month) || '-01' AS DATE), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM totals) SELECT s.month, coalesce(total_paise, 0) AS total_paise, coalesce(payments, 0) AS payments FROM s LEFT JOIN totals USING (month)")
def spine(spark, sf):
    return L.month_spine(L.month_totals(ledger(spark, sf)))


@query("ledger_newest", SQL_LEDGER + "SELECT id, paid_date, paid_time, amount_paise FROM counted ORDER BY paid_date DESC, paid_time DESC NULLS LAST, id LIMIT 50")
def newest(spark, sf):
    rows = ledger(spark, sf).where("bucket = 'COUNTED'")
    return rows.orderBy(F.desc("paid_date"), F.desc_nulls_last("paid_time"), "id").limit(50).select("id", "paid_date", "paid_time", "amount_paise")


@query("ledger_not_spending_split", SQL_LEDGER + "SELECT outcome <> 'SUCCESS' AS not_successful, count(*) AS payments FROM ledger WHERE bucket = 'NOT_SPENDING' GROUP BY 1")
def split(spark, sf):
    return ledger(spark, sf).where("bucket = 'NOT_SPENDING'").groupBy((F.col("outcome") != "SUCCESS").alias("not_successful")).agg(F.count("*").alias("payments"))


def sql_grouped(whole: str) -> str:
    """Indian grouping of a whole number's text in DuckDB: the last three digits, and pairs before them."""
    head = f"substr({whole}, 1, length({whole}) - 3)"
    return f"CASE WHEN length({whole}) <= 3 THEN {whole} ELSE ltrim(reverse(regexp_replace(reverse({head}), '(..)', '\\1,', 'g')), ',') || ',' || right({whole}, 3) END"


@query("money_format", SQL_LEDGER + f", w AS (SELECT id, amount_paise AS p, CAST(abs(amount_paise) // 100 AS VARCHAR) AS w FROM payments WHERE amount_paise IS NOT NULL) SELECT id, '₹' || CASE WHEN p < 0 THEN '-' ELSE '' END || {sql_grouped('w')} || CASE WHEN p % 100 <> 0 THEN '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') ELSE '' END AS shown FROM w")
def money(spark, sf):
    return payments(spark, sf).where("amount_paise is not null").select("id", L.money(F.col("amount_paise")).alias("shown"))


@query("ledger_resolve_month", SQL_LEDGER + """, q(query_id, month_number, year, relative) AS (VALUES (1, NULL, NULL, 'THIS_MONTH'), (2, NULL, NULL, 'LAST_MONTH'), (3, 9, NULL, NULL), (4, 3, 1996, NULL), (5, NULL, NULL, NULL))
SELECT query_id, CASE WHEN relative = 'THIS_MONTH' THEN '1998-06' WHEN relative = 'LAST_MONTH' THEN '1998-05' WHEN month_number IS NULL THEN NULL WHEN year IS NOT NULL THEN year || '-' || lpad(CAST(month_number AS VARCHAR), 2, '0')
ELSE coalesce((SELECT max(month) FROM totals WHERE CAST(substr(month, 6, 2) AS INT) = month_number AND month <= '1998-06'), (CASE WHEN month_number <= 6 THEN 1998 ELSE 1997 END) || '-' || lpad(CAST(month_number AS VARCHAR), 2, '0')) END AS month FROM q""")
def resolved(spark, sf):
    asked = spark.createDataFrame([(1, None, None, "THIS_MONTH"), (2, None, None, "LAST_MONTH"), (3, 9, None, None), (4, 3, 1996, None), (5, None, None, None)], "query_id int, month_number int, year int, relative string")
    return L.resolve_month(asked, L.month_totals(ledger(spark, sf)), TODAY)
