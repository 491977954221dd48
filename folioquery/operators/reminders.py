"""Reminders for deadlines that were read from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_DAYS, MOST = 60, 5
# Fixed value: labels of deadlines in English, Telugu and Hindi.
DEADLINE = r"(?iu)\bdue\b|expir|valid\s*(?:till|until|up\s?to|thru|through)|last\s+date|deadline|renew|pay\s+(?:by|before)|submit\s+(?:by|before)|గడువు|చివరి తేదీ|अंतिम\s*(?:तिथि|तारीख)|देय|समाप्ति|नवीनीकरण"


def key() -> Column:
    return F.concat("value", F.lit("|"), F.lower(F.rtrim(F.trim(F.coalesce("label", F.lit(""))), F.lit(":"))))


def candidates(facts: DataFrame, items: DataFrame) -> DataFrame:
    """facts(fact_id, item_id, kind, label, value), items(item_id, item_name, status) -> what suggest() takes: labelled dates with a year, of INDEXED items."""
    dates = facts.where((F.col("kind") == "DATE") & ~F.col("value").startswith("--") & F.col("label").isNotNull())
    return dates.join(items.where("status = 'INDEXED'").select("item_id", "item_name"), "item_id").select("fact_id", "item_id", "item_name", "label", "value")


def suggest(dates: DataFrame, today: str, dismissed: DataFrame | None = None) -> DataFrame:
    """dates(fact_id, item_id, item_name, label, value): the nearest MOST deadlines of the coming WINDOW_DAYS days.

    A value with a time is no date and gives no reminder. Equal keys count once, for the first fact.
    """
    rows = dates.where(F.col("label").rlike(DEADLINE) & ~F.col("value").startswith("--")).withColumn("day", F.try_to_date("value", "yyyy-MM-dd"))
    rows = rows.withColumn("days_away", F.datediff("day", F.lit(today).cast("date"))).where(F.col("days_away").between(0, WINDOW_DAYS)).withColumn("key", key())
    if dismissed is not None:
        rows = rows.join(dismissed.select("key"), "key", "left_anti")
    first = rows.groupBy("key").agg(F.min_by(F.struct("fact_id", "item_id", "item_name", "label", "value", "days_away"), "fact_id").alias("f")).select("key", "f.*")
    return first.orderBy("days_away", "item_name", "fact_id").limit(MOST)
