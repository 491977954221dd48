from pyspark.sql import functions as F

from folioquery.functions import text as T


def test_highlights_and_snippet(spark):
    df = spark.createDataFrame([("Fee receipt paid\nTotal fees: 500", ["fee", "paid"])], "text string, terms array<string>")
    row = df.select(T.highlights("text", "terms").alias("h"), T.snippet(F.col("text"), F.col("terms")).alias("s")).first()
    assert [(x.start, x.end) for x in row.h] == [(0, 3), (12, 16), (23, 27)]
    assert row.s == "Fee receipt paid · Total fees: 500"


def test_explanation(spark):
    df = spark.createDataFrame([("Fee paid fee", [(0, 3), (9, 12)], 1, 2), ("x", [], 1, None), ("x", [], None, 1), ("x", [], None, None)], "s string, h array<struct<start:int,end:int>>, k int, m int")
    got = [r[0] for r in df.select(T.explanation(F.col("s"), F.col("h"), F.col("k"), F.col("m"), F.lit("Screenshot 1"), F.lit("2026-09-05").cast("date"))).collect()]
    assert got[0] == "Matched “Fee” in the text in your screenshot from 5 Sep, and it is close in meaning to your search."
    assert got[1] == "Matched your words in the text in your screenshot from 5 Sep." and got[2].startswith("No exact words") and got[3].startswith("Found in")


def test_shared_text(spark):
    df = spark.createDataFrame([(" a \n b ",), ("",), ("word " * 100,)], "t string")
    got = [r[0] for r in df.select(T.shared_text(F.col("t"))).collect()]
    assert got[0] == "a b" and got[1] is None and got[2].endswith("word") and 295 <= len(got[2]) <= 300
