"""The scalar functions of the engine as functions of SQL, and over columns of texts."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions import calc, names
from folioquery.functions.facts import read_facts

OUTCOME = "kind string, primary string, secondary array<string>, reading string"


def calculate(text: Column, today: str, rates: list[tuple[str, str, str, str]] = ()) -> Column:
    """Outcome of each text; rates: from, to, rate, day it was saved."""
    day, book = date.fromisoformat(today), {(a, b): (Decimal(r), date.fromisoformat(d)) for a, b, r, d in rates}

    @F.pandas_udf(OUTCOME)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [calc.evaluate(t, day, book) for t in texts]
        return pd.DataFrame([(x.kind, x.primary, x.secondary, x.reading) if x else (None, None, None, None) for x in found], columns=["kind", "primary", "secondary", "reading"])

    return run(text)


def commands(texts: DataFrame) -> DataFrame:
    """texts(query_id, text) -> query_id, kind, value: minutes of the day of an alarm (two rows if open), seconds of a timer."""

    @F.pandas_udf("array<struct<kind:string,value:int>>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [{"kind": k, "value": v} for k, v in calc.command(t)])

    return texts.select("query_id", F.explode(run(F.col("text"))).alias("c")).select("query_id", "c.kind", "c.value")


def register(spark: SparkSession) -> None:
    """name_score, sound_key, edit_distance and fact_values for SQL."""

    def one(f, kind):
        @F.pandas_udf(kind)
        def run(a: pd.Series) -> pd.Series:
            return a.map(lambda x: None if x is None else f(x))

        return run

    def two(f, kind):
        @F.pandas_udf(kind)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=object)

        return run

    spark.udf.register("name_score", two(names.name_score, "double"))
    spark.udf.register("edit_distance", two(lambda a, b: int(names.distance(a, b)), "int"))
    spark.udf.register("sound_key", one(names.sound_key, "string"))
    spark.udf.register("fact_values", one(lambda t: [f"{f.kind}:{f.value}" for f in read_facts(t)], "array<string>"))
