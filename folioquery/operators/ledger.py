"""The ledger: each payment in exactly one bucket, exact totals in paise, roll-ups by month and payee.

payments has id, item_id, app, outcome, direction, amount_paise, amount_confidence, payee, upi_id, paid_date (ISO text),
paid_time, reference, problem and decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CONFIDENCE, SALTS = 0.6, 16


def payee_key(name: Column) -> Column:
    key = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}@]+", " "))
    return F.when(key != "", key)


def payee_name() -> Column:
    return F.coalesce("payee", "upi_id", F.lit("Unknown payee"))


def dedupe_key() -> Column:
    """Two records of one payment share it: the reference, or else amount, payee, date and time together."""
    key = payee_key(F.coalesce("payee", "upi_id"))
    stamp = F.concat(F.lit("ts:"), F.col("amount_paise").cast("string"), F.lit("|"), key, F.lit("|"), F.col("paid_date"), F.lit("|"), F.col("paid_time"))
    return F.when(F.col("reference").isNotNull(), F.concat(F.lit("ref:"), F.col("reference"))).otherwise(stamp)


def buckets(payments: DataFrame) -> DataFrame:
    """payments with bucket, duplicate_of and amounts_differ.

    Of records of one payment one counts: decided to be included, else of the surest amount, else of the least id. It is an
    aggregate of each key, with partial sums; only keys of several records are joined back, each in SALTS rows.
    """
    readable = F.col("problem").isNull() & F.col("amount_paise").isNotNull() & F.col("paid_date").isNotNull()
    spending = (F.col("outcome") == "SUCCESS") & (F.col("direction") == "PAID")
    rows = payments.withColumn("first", F.when(~readable, "UNREADABLE").when(~spending, "NOT_SPENDING")).withColumn("key", F.when(F.col("first").isNull(), dedupe_key()))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    place = F.struct((F.coalesce("decision", F.lit("")) != "INCLUDE").alias("a"), (-F.col("amount_confidence")).alias("b"), F.col("id").alias("c"))
    best = rows.where("key is not null").groupBy("key").agg(F.min_by(F.struct("id", "amount_paise"), place).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = best.select("key", F.col("best.id").alias("of"), F.col("best.amount_paise").alias("of_amount"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    all_ = rows.join(best, ["key", "salt"], "left")
    decided = F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("of") != F.col("id"), "DUPLICATE").when(F.col("decision") == "EXCLUDE", "EXCLUDED")
    bucket = decided.when((F.col("decision") == "INCLUDE") | (F.col("amount_confidence") >= LEAST_CONFIDENCE), "COUNTED").otherwise("NEEDS_CHECK")
    double = F.col("bucket") == "DUPLICATE"
    out = all_.withColumn("bucket", bucket).withColumn("duplicate_of", F.when(double, F.col("of"))).withColumn("amounts_differ", F.when(double, F.col("amount_paise") != F.col("of_amount")))
    return out.select(*payments.columns, "bucket", "duplicate_of", "amounts_differ")


def month() -> Column:
    return F.date_format(F.try_to_date("paid_date", "yyyy-MM-dd"), "yyyy-MM")


def month_totals(ledger: DataFrame) -> DataFrame:
    counted = ledger.where("bucket = 'COUNTED'").withColumn("month", month()).where("month is not null")
    return counted.groupBy("month").agg(F.sum("amount_paise").alias("total_paise"), F.count("*").alias("payments"))


def payee_totals(ledger: DataFrame, only: str | None = None) -> DataFrame:
    """Totals by payee; a payee's name is that of its newest payment."""
    counted = ledger.where("bucket = 'COUNTED'").withColumn("month", month())
    counted = counted.where(F.col("month") == only) if only else counted
    newest = F.struct(F.col("paid_date"), F.coalesce("paid_time", F.lit("")), (-F.col("id")).alias("tie"))
    rows = counted.withColumn("key", F.coalesce(payee_key(payee_name()), F.lit("")))
    return rows.groupBy("key").agg(F.max_by(payee_name(), newest).alias("name"), F.sum("amount_paise").alias("total_paise"), F.count("*").alias("payments")).drop("key")


def spending_answer(ledger: DataFrame, only: str | None = None) -> DataFrame:
    """One row: the total and number counted in a month (all, if none), what awaits a check there, all that is unreadable."""
    scope = (month() == only) if only else F.lit(True)
    counted, check = scope & (F.col("bucket") == "COUNTED"), scope & (F.col("bucket") == "NEEDS_CHECK")
    return ledger.agg(F.coalesce(F.sum(F.when(counted, F.col("amount_paise"))), F.lit(0)).alias("total_paise"), F.count_if(counted).alias("payments"), F.count_if(check).alias("needs_check"), F.count_if(F.col("bucket") == "UNREADABLE").alias("unreadable"))


def indian_grouping(number: Column) -> Column:
    """12345678 -> 1,23,45,678; decimals stay."""
    parts = F.split(number, r"\.")
    whole = F.regexp_replace(parts[0], r"(?<=[0-9])(?=([0-9][0-9])*[0-9]{3}$)", ",")
    return F.when(F.size(parts) > 1, F.concat(whole, F.lit("."), parts[1])).otherwise(whole)


def money(paise: Column) -> Column:
    """Rupees with Indian grouping; decimals only where there are paise."""
    rest = F.lpad((F.abs(paise) % 100).cast("string"), 2, "0")
    whole = F.call_function("div", F.abs(paise), F.lit(100)).cast("string")  # whole numbers: doubles hold 53 bits only
    text = F.when(paise % 100 == 0, indian_grouping(whole)).otherwise(F.concat(indian_grouping(whole), F.lit("."), rest))
    return F.concat(F.lit("₹"), F.when(paise < 0, F.lit("-")).otherwise(F.lit("")), text)


def month_spine(totals: DataFrame, last: int = 12) -> DataFrame:
    """Each month between the first and the last with its total, zero where nothing was read; the newest last ones."""
    ends = totals.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    first, end = F.to_date(F.concat("a", F.lit("-01"))), F.to_date(F.concat("b", F.lit("-01")))
    spine = ends.where("a is not null").select(F.explode(F.sequence(F.greatest(first, F.add_months(end, 1 - last)), end, F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return spine.join(totals, "month", "left").select("month", F.coalesce("total_paise", F.lit(0)).alias("total_paise"), F.coalesce("payments", F.lit(0)).alias("payments"))


def resolve_month(asked: DataFrame, totals: DataFrame, today: str) -> DataFrame:
    """The month that each spending query means: asked(query_id, month_number, year, relative) -> query_id, month (null: all).

    A month without a year is the latest one with data that isn't in the future, else the latest such month at all.
    """
    now = F.date_format(F.lit(today).cast("date"), "yyyy-MM")
    data = totals.select("month", F.substring("month", 6, 2).cast("int").alias("number")).where(F.col("month") <= now).groupBy("number").agg(F.max("month").alias("latest"))
    rows = asked.join(data, F.col("month_number") == F.col("number"), "left")
    text = lambda y, m: F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"))
    y, m = F.substring(now, 1, 4).cast("int"), F.substring(now, 6, 2).cast("int")
    usual = text(F.when(F.col("month_number") <= m, y).otherwise(y - 1), F.col("month_number"))
    chosen = F.when(F.col("relative") == "THIS_MONTH", now).when(F.col("relative") == "LAST_MONTH", F.date_format(F.add_months(F.lit(today).cast("date"), -1), "yyyy-MM"))
    chosen = chosen.when(F.col("month_number").isNull(), None).when(F.col("year").isNotNull(), text(F.col("year"), F.col("month_number"))).otherwise(F.coalesce("latest", usual))
    return rows.select("query_id", chosen.alias("month"))
