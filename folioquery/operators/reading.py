"""Readers of page images, as an interface, and the rules for choosing between their readings."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CONFIDENCE, LEAST_LINE = 0.75, 0.5
TELUGU = r"[\x{0C00}-\x{0C7F}]"


class Reader(Protocol):
    """Turns binaryFile rows into (uri, text, confidence, dropped_lines); a model behind mapInArrow, or a stand-in in tests."""

    def read(self, files: DataFrame) -> DataFrame: ...


class Utf8Reader:
    """A stand-in that reads files which are text already."""

    def read(self, files: DataFrame) -> DataFrame:
        return files.select("uri", F.decode("content", "UTF-8").alias("text"), F.lit(1.0).alias("confidence"), F.lit(0).alias("dropped_lines"))


def confident_lines(rows: DataFrame) -> DataFrame:
    """rows(uri, lines: array<struct<text, confidence>>) as a reading: surer lines, their mean confidence, how many went."""
    kept = F.filter("lines", lambda x: (x["confidence"] >= LEAST_LINE) & (F.trim(x["text"]) != ""))
    mean = F.aggregate("kept", F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size("kept")
    rows = rows.withColumn("kept", kept)
    text = F.translate(F.array_join(F.transform("kept", lambda x: F.trim(x["text"])), "\n"), "‌‍", "")
    return rows.select("uri", text.alias("text"), F.when(F.size("kept") > 0, mean).otherwise(0.0).alias("confidence"), (F.size("lines") - F.size("kept")).alias("dropped_lines"))


def choose(rows: DataFrame, policy: str = "WHEN_DOUBTFUL", script: str = TELUGU, least: int = 5, share: float = 0.2) -> DataFrame:
    """rows(first, second, confidence, dropped_lines) with chosen and text: OFF, WHEN_DOUBTFUL or ALWAYS asks the second reader."""
    doubtful = (F.trim(F.coalesce("first", F.lit(""))) == "") | (F.col("confidence") < LEAST_CONFIDENCE) | (F.col("dropped_lines") > 0)
    asked = {"OFF": F.lit(False), "WHEN_DOUBTFUL": doubtful, "ALWAYS": F.lit(True)}[policy]
    second = F.coalesce("second", F.lit(""))
    count = lambda pattern: F.regexp_count(second, F.lit(pattern))
    fits = (count(script) >= least) & (count(script) >= share * count(r"\p{L}"))
    rows = rows.withColumn("chosen", F.when(asked & fits, "second").otherwise("first"))
    return rows.withColumn("text", F.when(F.col("chosen") == "second", F.col("second")).otherwise(F.col("first")))
