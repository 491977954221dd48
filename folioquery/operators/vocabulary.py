"""Vocabularies over tables: counted from texts, written to and read from model files, and applied to texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.pieces import BLANK, CONTROL, NORMAL, UNKNOWN, Encoder, Model, Normaliser
from folioquery.functions.text import words
from folioquery.sources.store import spread
from folioquery.sources.tables import files

#: Pieces of a vocabulary that is counted; letters that it takes besides.
MOST_WORDS, MOST_LETTERS = 8_000, 4_000
#: Characters of texts that are normalised at once.
RUN = 1 << 20


def counted(documents: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(piece, score) of the most frequent words, with a blank before them, and of all letters of such words, by the logarithm of their share; ties to the smaller word."""
    rows = documents.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    first = rows.orderBy(F.desc("n"), "word").limit(most)
    total = F.sum("n").alias("total")
    own = first.join(F.broadcast(first.agg(total))).select(F.concat(F.lit(BLANK), "word").alias("piece"), F.log(F.col("n") / F.col("total")).alias("score"))  # one row
    letters = first.select(F.explode(F.split("word", "")).alias("letter"), "n").where("letter <> ''").groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(MOST_LETTERS)
    alone = letters.join(F.broadcast(letters.agg(total))).select(F.col("letter").alias("piece"), (F.log(F.col("n") / F.col("total")) - 10).alias("score"))
    return own.unionByName(alone)


def model(pieces: DataFrame, charsmap: bytes = b"", **settings: bool) -> Model:
    """A model of pieces(piece, score): by score, ties by piece, after the marks that models begin with. A vocabulary is small by its nature; it comes to the driver."""
    rows = pieces.select("piece", F.col("score").cast("float")).orderBy(F.desc("score"), "piece").limit(MOST_WORDS + MOST_LETTERS).collect()
    marks = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL), (BLANK, -20.0, NORMAL)]
    return Model(marks + [(r["piece"], r["score"], NORMAL) for r in rows if r["piece"] != BLANK], charsmap, **settings)


def write_model(spark: SparkSession, own: Model, path: str) -> None:
    """One file; it is renamed once it is whole."""
    jvm = spark.sparkContext._jvm
    place, half = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(half, True)
    out.write(bytearray(own.file()))
    out.close()
    fs.delete(place, False)
    fs.rename(half, place)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of all model files in a folder: uri, id, piece, score, kind. A damaged file is an error that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    text, score, kind = zip(*Model.parse(content).pieces) if content else ((), (), ())
                except ValueError as e:
                    raise ValueError(f"{uri}: {e}") from e
                n = len(text)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(text, pa.string()), pa.array(score, pa.float32()), pa.array(kind, pa.int32())], names=["uri", "id", "piece", "score", "kind"])

    return files(spark, path).select("uri", "content").mapInArrow(run, "uri string, id int, piece string, score float, kind int")


def runs(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= RUN:
            yield held
            held, size = [], 0
    if held:
        yield held


def normalised(documents: DataFrame, charsmap: bytes, **settings: bool) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, text: replaced by the character map, longest match first; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Normaliser(charsmap, **settings)
        for batch in batches:
            out = [t for part in runs(batch.column(1).to_pylist()) for t in own.texts(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, text string")


def ids(documents: DataFrame, own: Model, longest: int = 512) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, ids as an embedding model takes them (between marks, cut to longest), n_ids of the whole text without marks; null is empty."""
    content = own.file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model.parse(content))
        for batch in batches:
            out = [x for part in runs(batch.column(1).to_pylist()) for x in encoder.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.framed(x, longest) for x in out], pa.list_(pa.int32())), pa.array(list(map(len, out)), pa.int64())], names=["doc_id", "ids", "n_ids"])

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, ids array<int>, n_ids long")
