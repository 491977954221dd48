"""Registered queries of fuzzy names, over suppliers, customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.operators import names as O
from folioquery.plans.registry import query
from folioquery.sources.tables import table


#: A syllable for each digit, of which names are made.
SYLLABLES = ["ka", "ri", "mo", "te", "su", "na", "phi", "ghu", "lo", "cha"]


def spoken(number):
    """Two words of four syllables, one for each digit of a number."""
    digits = F.split(F.lpad(number.cast("string"), 8, "0"), "")
    word = lambda first: F.initcap(F.array_join(F.transform(F.slice(digits, first, 4), lambda d: F.element_at(F.array(*map(F.lit, SYLLABLES)), d.cast("int") + 1)), ""))
    return F.concat(word(1), F.lit(" "), word(5))


SQL_WORD = "array_to_string(list_transform(string_split(substr(d, {first}, 4), ''), lambda c: ([" + ", ".join(f"'{x}'" for x in SYLLABLES) + "])[CAST(c AS INTEGER) + 1]), '')"
SQL_SPOKEN = " || ' ' || ".join(f"upper(substr({w}, 1, 1)) || substr({w}, 2)" for w in (SQL_WORD.format(first=1), SQL_WORD.format(first=5)))


@query("contact_search", f"SELECT id AS query_id, {SQL_SPOKEN} AS name, CAST(1 AS DOUBLE) AS score, 1 AS rank FROM (SELECT s_suppkey AS id, lpad(CAST(s_suppkey * 48271 % 99999989 AS VARCHAR), 8, '0') AS d FROM supplier)")
def contacts(spark, sf):
    """For each supplier, called by the whole name, the contact that is meant first."""
    rows = table(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"), spoken(F.col("s_suppkey") * 48_271 % 99_999_989).alias("name"), F.concat(F.lit("+91 98765"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("number"))
    typed = rows.select(F.col("id").alias("query_id"), F.concat(F.lit("call "), F.lower("name")).alias("text"))
    return O.search_contacts(rows, typed).where("rank = 1").select("query_id", "name", F.round("score", 6).alias("score"), "rank")


def nations_typed(spark, sf):
    """For each nation its name in lower case: in a request, without its second letter, with two letters swapped, or its first four."""
    k, n = F.col("n_nationkey") % 4, F.lower("n_name")
    text = F.when(k == 0, F.concat(F.lit("open "), n)).when(k == 1, F.concat(F.substring(n, 1, 1), n.substr(F.lit(3), F.length(n)))).when(k == 2, F.concat(F.substring(n, 2, 1), F.substring(n, 1, 1), n.substr(F.lit(3), F.length(n)))).otherwise(F.substring(n, 1, 4))
    return table(spark, sf, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("query_id"), text.alias("text"))


@query("nation_search")
def nations(spark, sf):
    """The nations that a typed name may mean, as apps would be found."""
    rows = table(spark, sf, "nation", "n_nationkey", "n_name").select(F.col("n_name").alias("label"), F.concat(F.lit("org.nation."), F.lower("n_name")).alias("package"), F.col("n_nationkey").cast("string").alias("component"))
    return O.search_apps(rows, nations_typed(spark, sf)).select("query_id", "label", F.round("score", 6).alias("score"), "rank")


def customers(spark, sf):
    return table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), spoken(F.col("c_custkey") * 48_271 % 99_999_989).alias("name"), F.concat(F.lit("+91 9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("number"))


def typed(spark, sf):
    """A request for each 25th customer: the last word with two letters swapped, one left out or a sound spelt otherwise, the first word, or the whole name."""
    own = customers(spark, sf).where("id % 25 = 0").withColumn("w", F.split("name", " "))
    last, k = F.col("w")[1], F.col("id") / 25 % 5
    swapped = F.concat(F.substring(last, 1, 2), F.substring(last, 4, 1), F.substring(last, 3, 1), F.expr("substring(w[1], 5)"))
    lacking = F.concat(F.substring(last, 1, 3), F.expr("substring(w[1], 5)"))
    text = F.when(k == 0, swapped).when(k == 1, lacking).when(k == 2, F.translate(last, "gd", "kt")).when(k == 3, F.col("w")[0]).otherwise(F.col("name"))
    return own.select(F.col("id").alias("query_id"), F.concat(F.lit("call "), F.lower(text)).alias("text"))


@query("name_search")
def found(spark, sf):
    """The customers that each typed name may mean."""
    return O.search_contacts(customers(spark, sf), typed(spark, sf)).select("query_id", "id", "name", F.round("score", 6).alias("score"), "rank")
