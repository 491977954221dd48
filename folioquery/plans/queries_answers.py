"""Registered queries of question answering, over texts made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import answers as A
from folioquery.operators import facts as X
from folioquery.operators import retrieval as R
from folioquery.plans.queries_facts import texts
from folioquery.plans.queries_ledger import sql_grouped
from folioquery.plans.registry import query
from folioquery.sources.tables import table

ASKED = [(1, "how much did I pay to shop abc"), (2, "when did I pay shop bcd"), (3, "amount 500"), (4, "what is the amount paid to shop cde?"), (5, "how much did I spend last month"), (6, "phone number of shop def"), (7, "photos of the beach"), (8, "कितना पैसा दिया"), (9, "how much did I pay for zeppelin")]


def questions(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string")


def results(spark, sf):
    own = texts(spark, sf)
    chunks = own.select(F.col("item_id").alias("chunk_id"), "item_id", "text")
    found = R.bm25(chunks, questions(spark), R.RECOMMENDED, 10).withColumnRenamed("chunk_id", "item_id")
    return found.join(own, "item_id").select("query_id", "rank", "item_id", "text", F.lit(None).cast("int").alias("meaning_rank"), F.lit(None).cast("double").alias("meaning_score"))


@query("classify_questions", "SELECT c_custkey AS query_id, CASE c_custkey % 6 WHEN 0 THEN 'AMOUNT' WHEN 1 THEN 'DATE' WHEN 3 THEN 'AMOUNT' WHEN 4 THEN 'PHONE' END AS kind FROM customer")
def classified(spark, sf):
    """Questions about customers: amounts, days and numbers in words of several languages, spending and plain words."""
    typed = table(spark, sf, "customer", "c_custkey", "c_name").selectExpr("c_custkey AS query_id", "CASE c_custkey % 6 WHEN 0 THEN concat(c_name, ' ने कितना दिया') WHEN 1 THEN concat(c_name, ' eppudu') WHEN 2 THEN concat('how much did I spend at ', c_name) WHEN 3 THEN concat('what is the total of ', c_name, '?') WHEN 4 THEN concat('helpline ', c_name) ELSE concat('total ', c_name) END AS text")
    return A.classify(typed).select("query_id", "kind")


@query("answers")
def answered(spark, sf):
    """Only the items that were found go through fact reading."""
    found = results(spark, sf)
    top = found.where("rank = 1").select("item_id", "text").distinct()
    own = texts(spark, sf).select(F.col("item_id").alias("chunk_id"), "item_id", "text")
    return A.ask(found, questions(spark), X.facts(top), R.Index(own, R.postings(own), R.statistics(own)), A.AnswerOptions(True, True, True))


SQL_YEARLESS = "make_date(2024, CAST(1 + p_partkey % 12 AS INTEGER), CAST(1 + p_partkey % 28 AS INTEGER))"


@query("display_values", f"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN strftime({SQL_YEARLESS}, '%-d %b') || ' (year not read)' WHEN 1 THEN strftime({SQL_YEARLESS}, '%-d %b %Y') || ', 6:45 PM' WHEN 2 THEN '+91 98765 ' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') ELSE p_name END AS shown FROM part")
def shown(spark, sf):
    """Days without a year, days with a time, phone numbers and addresses as they are shown."""
    day = "make_date(2024, 1 + p_partkey % 12, 1 + p_partkey % 28)"
    rows = table(spark, sf, "part", "p_partkey", "p_name").selectExpr("p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN 'DATE' WHEN 1 THEN 'DATE' WHEN 2 THEN 'PHONE' ELSE 'ADDRESS' END AS kind", f"CASE p_partkey % 4 WHEN 0 THEN date_format({day}, '--MM-dd') WHEN 1 THEN concat(date_format({day}, 'yyyy-MM-dd'), 'T18:45') WHEN 2 THEN concat('+9198765', lpad(CAST(p_partkey % 100000 AS STRING), 5, '0')) ELSE p_name END AS value")
    return rows.select("id", A.display(F.col("kind"), F.col("value")).alias("shown"))


@query("questions_classified", "SELECT o_orderkey AS query_id, CASE o_orderkey % 7 WHEN 0 THEN 'AMOUNT' WHEN 1 THEN 'DATE' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'ADDRESS' WHEN 4 THEN 'AMOUNT' END AS kind FROM orders")
def kinds(spark, sf):
    """Questions made of the orders' numbers, by what they ask for; spending and plain words ask for nothing."""
    typed = table(spark, sf, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey AS query_id", "CASE o_orderkey % 7 WHEN 0 THEN concat('how much was bill ', o_custkey) WHEN 1 THEN concat('when is bill ', o_custkey, ' due') WHEN 2 THEN concat('phone number of shop ', o_custkey) WHEN 3 THEN concat('address of shop ', o_custkey) WHEN 4 THEN concat('what is the total of ', o_custkey, '?') WHEN 5 THEN concat('how much did I spend at ', o_custkey) ELSE concat('photos of trip ', o_custkey) END AS text")
    return A.classify(typed).select("query_id", "kind")


@query("facts_displayed", f"WITH w AS (SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS p, CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) AS w FROM orders) SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '₹' || {sql_grouped('w')} || CASE WHEN p % 100 = 0 THEN '' ELSE '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') END WHEN 1 THEN strftime(o_orderdate, '%-d %b %Y') ELSE '+91 98765 ' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS shown FROM w")
def displayed(spark, sf):
    """Amounts, dates and phone numbers of the orders as they are shown."""
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice").selectExpr("o_orderkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'AMOUNT' WHEN 1 THEN 'DATE' ELSE 'PHONE' END AS kind", "CASE o_orderkey % 3 WHEN 0 THEN regexp_replace(regexp_replace(format_number(o_totalprice, 2), ',', ''), '[.]00$', '') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE concat('+9198765', lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')) END AS value")
    return rows.select("id", A.display(F.col("kind"), F.col("value")).alias("shown"))
