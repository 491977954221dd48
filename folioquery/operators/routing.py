"""Where a typed text goes - calculator, ledger, question, command, names, file search - and what may be done with a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators import answers, names, scalars

# Fixed value: phrases of relative months.
THIS_MONTH = r"(?iu)this month|इस महीने|ఈ నెల|\bis mahine\b|\bee nela\b"
LAST_MONTH = r"(?iu)last month|पिछले महीने|గత నెల|\bpichle mahine\b|\bgata nela\b"


def spending(texts: DataFrame) -> DataFrame:
    """texts(query_id, text) about spending -> query_id, month_number, year, relative."""
    from folioquery.functions.facts import MONTHS
    from folioquery.functions.text import words

    months = F.create_map(*[x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))])
    own = texts.where(F.col("text").rlike(f"(?iu){answers.SPENDING}")).withColumn("w", words(F.col("text")))
    number = F.get(F.filter(F.transform("w", lambda x: F.try_element_at(months, x)), lambda n: n.isNotNull()), F.lit(0))
    year = F.get(F.filter("w", lambda x: x.rlike("^20[0-9]{2}$|^2100$")), F.lit(0)).cast("int")
    relative = F.when(F.col("text").rlike(THIS_MONTH), "THIS_MONTH").when(F.col("text").rlike(LAST_MONTH), "LAST_MONTH")
    return own.select("query_id", number.alias("month_number"), year.alias("year"), relative.alias("relative"))


def route(texts: DataFrame, today: str, apps: DataFrame | None = None, contacts: DataFrame | None = None, settings: DataFrame | None = None, mode: str = "MERGED") -> DataFrame:
    """texts(query_id, text) -> query_id, kinds (in order, joined by commas), detail, understood. A blank text goes nowhere."""
    spark = texts.sparkSession
    rows = texts.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn("calc", scalars.calculate(F.col("text"), today))
    rows = rows.join(spending(texts).select("query_id", F.lit(True).alias("spends"), "relative", "month_number"), "query_id", "left")
    rows = rows.join(answers.classify(texts).select("query_id", F.col("kind").alias("asked")), "query_id", "left")
    rows = rows.join(scalars.commands(texts).groupBy("query_id").agg(F.min("kind").alias("commanded"), F.lit(True).alias("commands")), "query_id", "left")
    requests = texts.where("text is not null").select("query_id", "text")
    for column, table, search in (("app", apps, names.search_apps), ("contact", contacts, names.search_contacts), ("setting", settings, names.search_settings)):
        hits = search(table, requests) if table is not None else spark.createDataFrame([], "query_id long, rank int, label string, name string")
        label = F.min_by(F.col("name" if column == "contact" else "label"), "rank")
        rows = rows.join(hits.groupBy("query_id").agg(label.alias(f"{column}_label"), F.lit(True).alias(column)), "query_id", "left")
    files = F.lit("FILE_SEARCH")
    several = F.concat_ws(",", F.when(F.col("commands"), "COMMAND"), F.when(F.col("setting"), "SETTINGS"), F.when(F.col("contact"), "CONTACT"), F.when(F.col("app"), "APP"), files)
    kinds = F.when(F.col("text") == "", "").when(F.col("calc.kind").isNotNull(), "CALCULATOR").when(F.col("spends"), F.concat(F.lit("SPENDING,"), files)).when(F.col("asked").isNotNull(), F.concat(F.lit("QUESTION,"), files)).otherwise(several)
    return rows.select("query_id", kinds.alias("kinds"), F.coalesce(F.col("calc.primary"), F.col("asked")).alias("detail"), understood(kinds, mode).alias("understood"))


# What a kind of question asks for, and how each mode of search looks.
ASKED_FOR = {"AMOUNT": "an amount", "DATE": "a date", "PHONE": "a phone number", "ADDRESS": "an address"}
HOW = {"MERGED": "by words and by meaning", "MEANING": "by meaning only", "KEYWORDS": "by exact words only"}


def understood(kinds: Column, mode: str) -> Column:
    """How the text was read, in plain words; over the columns that route() joins."""
    calc = F.when(F.col("calc.kind") == "FAILED", "This looks like a calculation, but it cannot be worked out.").when(F.col("calc.kind") == "RATE_PROPOSAL", "You typed an exchange rate. Nothing is saved unless you choose to save it.").otherwise("A calculation, worked out on this phone.")
    scope = F.when(F.col("relative") == "THIS_MONTH", "this month").when(F.col("relative") == "LAST_MONTH", "last month").when(F.col("month_number").isNotNull(), "the month you named").otherwise("all months")
    spending_ = F.concat(F.lit("A spending question: adding up the payment screenshots that could be read for "), scope, F.lit(". Matching files are listed too."))
    what = F.create_map(*[F.lit(x) for pair in ASKED_FOR.items() for x in pair])[F.col("asked")]
    question = F.concat(F.lit("A question asking for "), what, F.lit(": looking in your files, and answering from the best match only if it is clearly the right one."))
    name = lambda column, text: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"the {text} “"), F.col(column), F.lit("”")))
    names_ = F.concat_ws(" or ", name("setting_label", "settings screen"), name("contact_label", "contact"), name("app_label", "app"))
    files = F.concat(F.lit("ooking in your files for “"), F.col("text"), F.lit(f"”, {HOW[mode]}."))
    command = F.concat(F.lit("Reads this as a request to set "), F.when(F.col("commanded") == "ALARM", "an alarm").otherwise("a timer"), F.lit(". Nothing is set until you confirm."))
    return (
        F.when(F.col("text") == "", F.lit(None)).when(F.col("calc.kind").isNotNull(), calc).when(F.col("spends"), spending_).when(F.col("asked").isNotNull(), question)
        .when((kinds == "COMMAND,FILE_SEARCH"), command).when(names_ != "", F.concat(F.lit("Matches "), names_, F.lit(". Also l"), files)).otherwise(F.concat(F.lit("L"), files))
    )


def event_day(value: Column, today: str) -> Column:
    """The day of a stored date; one without a year is the next on or after today, 29 February within eight years; null if there is none."""
    day, now = F.substring_index(value, "T", 1), F.lit(today).cast("date")
    years = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.try_to_date(F.concat((F.year(now) + k).cast("string"), F.substring(day, 2, 6)), "yyyy-MM-dd"))
    return F.when(value.startswith("--"), F.get(F.filter(years, lambda d: d.isNotNull() & (d >= now)), F.lit(0))).otherwise(F.try_to_date(day, "yyyy-MM-dd"))


def calendar_times(facts: DataFrame, today: str, zone: str) -> DataFrame:
    """facts(fact_id, value, ...) that are days, or days with a time -> fact_id, all_day, begin_ms, end_ms.

    A whole day is from midnight to midnight of UTC, as calendars store it; an event with a time lasts an hour from that time
    in the zone. Values that are no day, or whose time is none, are left out.
    """
    clock = F.when(F.contains(F.col("value"), F.lit("T")), F.substring_index("value", "T", -1))
    rows = facts.select("fact_id", event_day(F.col("value"), today).alias("day"), clock.alias("clock")).where("day IS NOT NULL")
    valid = F.col("clock").isNull() | F.col("clock").rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")
    local = F.concat(F.col("day").cast("string"), F.lit(" "), F.coalesce("clock", F.lit("00:00")), F.lit(":00")).cast("timestamp_ntz")
    utc = F.when(F.col("clock").isNull(), local).otherwise(F.convert_timezone(F.lit(zone), F.lit("UTC"), local))
    begin = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)
    rows = rows.where(valid)
    return rows.select("fact_id", F.col("clock").isNull().alias("all_day"), begin.alias("begin_ms")).withColumn("end_ms", F.col("begin_ms") + F.when(F.col("all_day"), 86_400_000).otherwise(3_600_000))


def actions(facts: DataFrame, today: str) -> DataFrame:
    """What each of facts(fact_id, kind, value, confidence) can be used for: fact_id, action, target, note. Sharing is always one."""
    yearless = F.col("value").startswith("--")
    now = F.lit(today).cast("date")
    when = event_day(F.col("value"), today)
    clock = F.when(F.contains(F.col("value"), F.lit("T")), F.substring_index("value", "T", -1))
    unsure = (F.col("confidence") < 0.6) | yearless
    event = F.concat(when.cast("string"), F.coalesce(F.concat(F.lit("T"), clock, F.lit("/1h")), F.lit("/all-day")))
    note = F.concat_ws("; ", F.when(yearless, "year not read"), F.when(when < now, "in the past"), F.when(F.col("confidence") < 0.6, "low confidence"))

    def one(kind: str, action: str, target: Column) -> Column:
        return F.when((F.col("kind") == kind) & target.isNotNull(), F.struct(F.lit(action).alias("action"), target.alias("target")))

    plans = F.array(one("DATE", "CALENDAR", event), one("PHONE", "CALL", F.concat(F.lit("tel:"), F.col("value"))), one("ADDRESS", "MAPS", F.concat(F.lit("geo:0,0?q="), F.url_encode("value"))), F.struct(F.lit("SHARE").alias("action"), F.col("value").alias("target")))
    rows = facts.select("fact_id", unsure.alias("low_confidence"), F.when(F.col("kind") == "DATE", note).otherwise("").alias("note"), F.explode(F.filter(plans, lambda p: p.isNotNull())).alias("p"))
    return rows.select("fact_id", "p.action", "p.target", "note", "low_confidence")
