"""Seeded documents whose facts are known, and questions about them: what evaluations are run on.

Everything follows from a seed and from rows(id, name, paise, day), so that a corpus of any size is made where its rows lie
and is the same each time. A document's anchor, by which questions name it, is unique; that is checked, not hoped for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS, TYPES = ("en", "hi", "te"), ("bill", "receipt", "card", "note")
# Labels by language.
LABELS = {
    "bill": ("electricity bill", "बिजली बिल", "విద్యుత్ బిల్లు"), "amount": ("Amount due", "कुल राशि", "మొత్తం"), "due": ("Due date", "अंतिम तिथि", "గడువు తేదీ"), "receipt": ("payment receipt", "भुगतान रसीद", "చెల్లింపు రసీదు"),
    "paid": ("Paid", "जमा", "చెల్లించిన"), "date": ("Date", "दिनांक", "తేదీ"), "card": ("visiting card", "विजिटिंग कार्ड", "విజిటింగ్ కార్డు"), "phone": ("Phone", "फोन", "ఫోన్"), "address": ("Address", "पता", "చిరునామా"),
    "note": ("meeting notes", "बैठक के नोट", "సమావేశ గమనికలు"),
}
QUESTIONS = {
    "bill": ("how much is the bill {}", "{} बिल कितना है", "{} బిల్లు ఎంత"), "receipt": ("when was receipt {} paid", "{} रसीद कब", "{} రసీదు ఎప్పుడు"), "card": ("phone number of {}", "{} फोन नंबर", "{} ఫోన్ నంబర్"), "note": ("notes {}", "{} नोट", "{} గమనికలు"),
}


def by_lang(texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), F.col("l") + 1)


def unique(rows: DataFrame, column: str) -> DataFrame:
    """rows, which raise an error where a value of column comes again; counts have partial sums."""
    twice = rows.groupBy(column).agg(F.count("*").alias("times"))
    checked = F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit(f"{column} comes again: "), F.col(column)))).otherwise(F.col("times"))
    return rows.join(twice, column).where(checked.isNotNull()).drop("times")


def documents(rows: DataFrame, seed: int = 1) -> DataFrame:
    """rows(id, name, paise, day) -> doc_id, type, lang, anchor, text, facts (kind to value). Types and languages go in turn, from where the seed says."""
    own = rows.select(F.col("id").cast("long").alias("id"), "name", F.col("paise").cast("long").alias("paise"), F.col("day").cast("date").alias("day"))
    own = own.withColumns({"t": F.pmod(F.col("id") * 7 + seed, F.lit(len(TYPES))).cast("int"), "l": F.pmod(F.col("id") * 5 + seed, F.lit(len(LANGS))).cast("int")})
    own = own.withColumn("anchor", F.concat(F.lit("zq"), F.translate((F.col("id") * 1_000 + seed % 1_000).cast("string"), "0123456789", "abcdefghij")))
    rupees = F.concat(F.call_function("div", F.col("paise"), F.lit(100)).cast("string"), F.when(F.col("paise") % 100 > 0, F.concat(F.lit("."), F.lpad((F.col("paise") % 100).cast("string"), 2, "0"))).otherwise(""))
    phone = F.lpad((F.col("id") % 100_000).cast("string"), 5, "0")
    place = F.concat(F.lit("Plot "), (F.col("id") % 997).cast("string"), F.lit(", Lake Road"))
    line = lambda label, value: F.concat(by_lang(LABELS[label]), F.lit(": "), value)
    title = lambda kind: F.concat(F.col("name"), F.lit(" "), by_lang(LABELS[kind]), F.lit(" "), F.col("anchor"))
    texts = {
        "bill": F.concat_ws("\n", title("bill"), line("amount", F.concat(F.lit("₹"), rupees)), line("due", F.date_format("day", "dd/MM/yyyy"))),
        "receipt": F.concat_ws("\n", title("receipt"), line("paid", F.concat(F.lit("Rs "), rupees)), line("date", F.date_format("day", "d MMM yyyy"))),
        "card": F.concat_ws("\n", title("card"), line("phone", F.concat(F.lit("98765 "), phone)), line("address", place)),
        "note": title("note"),
    }
    value = F.when(F.contains(rupees, F.lit(".")), F.regexp_replace(rupees, r"0+$", "")).otherwise(rupees)
    iso = F.date_format("day", "yyyy-MM-dd")
    money = F.create_map(F.lit("AMOUNT"), value, F.lit("DATE"), iso)
    facts = {"bill": money, "receipt": money, "card": F.create_map(F.lit("PHONE"), F.concat(F.lit("+9198765"), phone), F.lit("ADDRESS"), place), "note": F.create_map().cast("map<string, string>")}
    choose = lambda of: F.element_at(F.array(*[of[t] for t in TYPES]), F.col("t") + 1)
    made = own.select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, TYPES)), F.col("t") + 1).alias("type"), F.element_at(F.array(*map(F.lit, LANGS)), F.col("l") + 1).alias("lang"), "anchor", choose(texts).alias("text"), choose(facts).alias("facts"))
    return unique(made, "anchor").select("doc_id", "type", "lang", "anchor", "text", "facts")


def questions(corpus: DataFrame, each: int = 10) -> DataFrame:
    """Of the documents whose number is divisible by each, one question: query_id, style, kind (value, find, negative), text, relevant (doc_id), value.

    A value is asked for by the document's anchor, in its language; notes are only looked for. Each third question of a value
    names an anchor that no document has: it has no right answer.
    """
    own = corpus.where(F.col("doc_id") % each == 0).withColumn("l", F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")).cast("int") - 1)
    negative = (F.col("type") != "note") & (F.call_function("div", F.col("doc_id"), F.lit(each)) % 3 == 0)
    anchor = F.when(negative, F.concat(F.lit("xw"), F.substring("anchor", 3, 40))).otherwise(F.col("anchor"))
    forms = F.create_map(*[x for t in TYPES for x in (F.lit(t), F.array(*map(F.lit, QUESTIONS[t])))])
    text = F.replace(F.element_at(forms[F.col("type")], F.col("l") + 1), F.lit("{}"), anchor)
    asked = F.create_map(F.lit("bill"), F.lit("AMOUNT"), F.lit("receipt"), F.lit("DATE"), F.lit("card"), F.lit("PHONE"))[F.col("type")]
    kind = F.when(F.col("type") == "note", "find").when(negative, "negative").otherwise("value")
    rows = own.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("style"), kind.alias("kind"), text.alias("text"), F.when(~negative, F.col("doc_id")).alias("relevant"), F.when(~negative, F.try_element_at("facts", F.coalesce(asked, F.lit("-")))).alias("value"))
    return rows
