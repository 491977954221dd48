"""The value at a place in the order of a group's values, exactly and without gathering a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.sources.store import written

#: Groups of more values are narrowed down first, to the values between two approximate quantiles this far from the one asked for.
SMALL, MARGIN, ACCURACY = 20_000, 0.001, 10_000
#: Groups whose bounds are broadcast, so that the rows stay where they are; those of more are joined.
SENT_GROUPS = 100_000


def value_at(rows: DataFrame, groups: list[str], column: str, share: float, place: Callable[[Column], Column], name: str) -> DataFrame:
    """groups and the value at place(n) (from 0) among each group's n values, as column name. share: about where that is, from 0 to 1.

    Values are counted; of a large group only those near the place are put in order, as many as a quantile sketch may be off by
    and more. Nulls don't count; a group without values has no row.
    """
    known = rows.where(F.col(column).isNotNull()).select(*groups, F.col(column).alias("value"))
    sketch = F.percentile_approx("value", F.array(F.lit(max(0.0, share - MARGIN)), F.lit(min(1.0, share + MARGIN))), ACCURACY)
    bounds = known.groupBy(*groups).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), sketch.alias("near"))
    large = F.col("n") > SMALL
    bounds = bounds.select(*groups, "n", F.when(large & (share > MARGIN), F.col("near")[0]).otherwise(F.col("least")).alias("low"), F.when(large & (share < 1 - MARGIN), F.col("near")[1]).otherwise(F.col("most")).alias("high"))
    bounds = written(bounds, "rank-bounds")  # a row for each group
    few = F.broadcast(bounds) if bounds.count() <= SENT_GROUPS else bounds
    met = known.join(few, groups) if groups else known.join(few)
    # What lies below counts with the lowest value that is looked at.
    level = F.when(F.col("value") < F.col("low"), F.lit(None)).otherwise(F.col("value"))
    counted = met.where(F.col("value") <= F.col("high")).groupBy(*groups, "n", level.alias("value")).agg(F.count("*").alias("here"))
    order = Window.partitionBy(*groups).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("here").over(order))
    return upto.where((F.col("upto") > place(F.col("n"))) & (F.col("upto") - F.col("here") <= place(F.col("n")))).select(*groups, F.col("value").alias(name))


def upper_median(rows: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """The upper one of the two middle values."""
    return value_at(rows, groups, column, 0.5, lambda n: F.floor(n / 2), name)


def nearest_rank(rows: DataFrame, groups: list[str], column: str, p: float, name: str) -> DataFrame:
    """The value at place round(p % of (n - 1)), halves to even."""
    return value_at(rows, groups, column, p / 100, lambda n: F.bround(F.lit(p / 100) * (n - 1)), name)
