"""Registered queries of the scalar functions, over fixed texts and over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import scalars
from folioquery.plans.queries_names import customers
from folioquery.plans.registry import query
from folioquery.sources.tables import table

TODAY = "2026-10-05"
#: What is typed by the order's number by 10, and what it works out to, without marks of grouping; a: the customer, b: 1 to 90.
SQL_HUNDREDTHS = "({p}) // 100 || CASE WHEN ({p}) % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(({p}) % 100 AS VARCHAR), 2, '0'), '0') END"
SUMS = [
    ("concat(a, ' + ', b, '%')", SQL_HUNDREDTHS.format(p="a * (100 + b)")), ("concat(b, '% of ', a)", SQL_HUNDREDTHS.format(p="a * b")), ("concat(a, '^2')", "a * a"), ("concat('two hundred and fifty plus ', b)", "250 + b"),
    ("concat(a, ' lakh')", "a * 100000"), ("concat(a, ' km to m')", "a * 1000 || ' m'"), ("concat(a, ' gb in mb')", "a * 1024 || ' MB'"), ("concat('in ', b, ' days')", f"strftime(DATE '{TODAY}' + CAST(b AS INTEGER), '%a %-d %b %Y')"),
    ("concat(a, ' usd to inr')", SQL_HUNDREDTHS.format(p="a * 8350") + " || ' INR'"), ("concat('order of ', a)", "NULL"),
]
by_tenth = lambda place: "CASE k " + " ".join(f"WHEN {k} THEN {x[place]}" if place == 0 else f"WHEN {k} THEN CAST({x[place]} AS VARCHAR)" for k, x in enumerate(SUMS)) + " END"


@query("calculate", f"SELECT id, {by_tenth(1)} AS shown FROM (SELECT o_orderkey AS id, o_orderkey % 10 AS k, o_custkey AS a, 1 + o_orderkey % 90 AS b FROM orders)")
def calculate(spark, sf):
    """Sums, shares, powers, words, units, dates and currencies, made of the orders' numbers."""
    rows = table(spark, sf, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey AS id", "o_orderkey % 10 AS k", "o_custkey AS a", "1 + o_orderkey % 90 AS b").selectExpr("id", f"{by_tenth(0)} AS text")
    return rows.select("id", F.replace(scalars.calculate(F.col("text"), TODAY, [("USD", "INR", "83.5", "2026-10-01")])["primary"], F.lit(","), F.lit("")).alias("shown"))


@query("calculate_columns", "SELECT o_orderkey, CAST(o_custkey + o_orderkey * 2 AS VARCHAR) AS value FROM orders")
def columns(spark, sf):
    sums = table(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.concat("o_custkey", F.lit(" + "), "o_orderkey", F.lit(" x 2")).alias("text"))
    return sums.select("o_orderkey", F.regexp_replace(scalars.calculate(F.col("text"), TODAY)["primary"], ",", "").alias("value"))


SQL_TYPED = "SELECT o_orderkey AS query_id, o_orderkey % 4 AS k, 1 + o_custkey % 12 AS h, o_custkey % 60 AS m FROM orders"


@query("commands", f"SELECT query_id, 'ALARM' AS kind, CAST((h % 12) * 60 + unnest([0, 720]) AS INTEGER) AS value FROM ({SQL_TYPED}) WHERE k = 0 UNION ALL SELECT query_id, 'ALARM', CAST((h % 12) * 60 + m + 720 AS INTEGER) FROM ({SQL_TYPED}) WHERE k = 1 UNION ALL SELECT query_id, 'TIMER', CAST((m + 1) * 60 AS INTEGER) FROM ({SQL_TYPED}) WHERE k = 2")
def commands(spark, sf):
    """Alarms with and without a half of the day, timers, and what only looks like one."""
    typed = table(spark, sf, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey AS query_id", "o_orderkey % 4 AS k", "1 + o_custkey % 12 AS h", "o_custkey % 60 AS m")
    return scalars.commands(typed.selectExpr("query_id", "CASE k WHEN 0 THEN concat('set alarm ', h) WHEN 1 THEN concat('alarm ', h, ':', lpad(CAST(m AS STRING), 2, '0'), ' pm') WHEN 2 THEN concat('timer ', m + 1, ' min') ELSE 'alarm clock shop' END AS text"))


SQL_SOUNDS = "translate(lpad(CAST(c_custkey * 48271 % 99999989 AS VARCHAR), 8, '0'), '0123456789', 'krmtsnpglc')"
for _c in "krmtsnpglc":
    SQL_SOUNDS = f"regexp_replace({SQL_SOUNDS}, '{_c}+', '{_c}', 'g')"


@query("sound_keys", f"SELECT c_custkey AS id, {SQL_SOUNDS} AS sounds, 1 AS edits, 1 AS swapped FROM customer")
def sounds(spark, sf):
    """The sounds of spoken names by SQL functions, and their edits from names with a letter less and with two letters swapped."""
    scalars.register(spark)
    names = customers(spark, sf).withColumn("n", F.lower("name"))
    other = "concat(substr(n, 1, 4), substr(n, 6, 1), substr(n, 5, 1), substr(n, 7))"
    return names.selectExpr("id", "sound_key(name) AS sounds", "CAST(edit_distance(n, substr(n, 2)) AS INT) AS edits", f"CAST(CASE WHEN substr(n, 5, 1) = substr(n, 6, 1) THEN 1 ELSE edit_distance(n, {other}) END AS INT) AS swapped")
