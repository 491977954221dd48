"""Facts and payments of texts, as rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions import facts as R
from folioquery.sources.store import spread

FACTS = "item_id long, kind string, value string, raw string, label string, line int, confidence double"
PAYMENT = "item_id long, app string, outcome string, direction string, amount_paise long, amount_confidence double, amount_raw string, payee string, upi_id string, paid_date string, paid_time string, reference string, problem string"


def mapped(texts: DataFrame, schema: str, read) -> DataFrame:
    """texts(item_id, text) through read(item_id, text) -> tuples, in batches."""
    spark = texts.sparkSession
    empty = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in read(item, text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return spread(texts.select(F.col("item_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


DIGIT = "[0-9०-९౦-౯٠-٩]"


def facts(texts: DataFrame, mode: str = "LOOKALIKE", kinds: Iterable[str] = R.KINDS) -> DataFrame:
    """Facts of texts(item_id, text) that are of these kinds. Texts without a digit or an address label have none and never reach Python."""
    kinds = tuple(kinds)
    worth = F.col("text").rlike(f"(?iu){DIGIT}|addr|venue|location|deliver|ship|చిరునామా|पता" if "ADDRESS" in kinds else DIGIT)
    return mapped(texts.where(worth), FACTS, lambda item, text: [(item, f.kind, f.value, f.raw, f.label, f.line, f.confidence) for f in R.read_facts(text, mode, kinds)])


def amounts(texts: DataFrame, modes: list[str]) -> DataFrame:
    """texts(text, ...) -> its rows with readings instead of the text: for each of modes, in their order, the value and confidence
    of the surest amount (of equally sure ones that of the first line) and every value that was read.

    A text is read once for all modes, and what it gives stays in its row, so that nothing is grouped or joined.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in texts.columns if c != "text"]
    schema = texts.select(*rest, F.lit(None).cast("array<struct<value: string, confidence: double, every: array<string>>>").alias("readings")).schema
    arrow, nothing = to_arrow_schema(schema), [[] for _ in modes]
    entry = arrow.field("readings").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, every = [], []
            for text in batch.column("text").to_pylist():
                for found in R.read_modes(text, modes, ("AMOUNT",)) if text else nothing:
                    top = min(found, key=lambda f: (-f.confidence, f.line), default=None) if len(found) != 1 else found[0]
                    tops.append((top.value, top.confidence) if top else (None, None))
                    every.append([f.value for f in found])
            columns = [*(zip(*tops) if tops else ((), ())), every]
            entries = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, entry)], fields=list(entry))
            readings = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(modes)), entries, type=arrow.field("readings").type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), readings], schema=arrow)

    worth = F.when(F.col("text").rlike(DIGIT), F.col("text"))
    return spread(texts.select(*rest, worth.alias("text"))).mapInArrow(run, schema)


def payments(texts: DataFrame) -> DataFrame:
    """Payments that texts(item_id, text) show; the cues are looked for before anything reaches Python."""
    worth = F.col("text").rlike(f"(?iu){R.UPI_SIGNAL}") & F.regexp_replace("text", r"[ \t]+", " ").rlike(f"(?iu){R.PAYMENT_CUE}")
    return mapped(texts.where(worth), PAYMENT, lambda item, text: [(item, *p.values())] if (p := R.read_payment(text)) else [])
