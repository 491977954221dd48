"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts and unlabelled ones, by the risk
pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]) with the logistic loss l and the class prior pi; where the second part falls
below zero, the step goes against its gradient. Unlabelled texts are drawn from all documents, whatever their labels, and pi
is the toxic share of labelled rows, which are taken for a draw from all. No text counts as a negative one. Features are the
words of a text, in lower case, and their beginnings, hashed; all those that stand out in toxic texts against unlabelled ones
take part. Fitting uses a bounded sample; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm import counting
from folioquery.llm.pretok import WordTable, _tables, chunks, texts_of
from folioquery.llm.shared import scratch, struct, written

BITS = 20
PREFIXES = (4, 5, 6)
#: Bounds of the sample that the classifier is fitted on, in rows, and tasks that read it.
MOST_POSITIVE, MOST_UNLABELLED, SAMPLE_TASKS = 6_000, 15_000, 8
#: A feature takes part if its share of toxic texts is so many times that of the others, and it stands in so many texts.
LEAST_LIFT, LEAST_TEXTS = 10.0, 4
THRESHOLD, HELD_OUT_FOLD, FOLDS = 0.7, 1, 3
STEPS, RATE, RIDGE = 400, 0.1, 1e-5


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT_FOLD


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each pre-token: the word and its beginnings; none for what isn't a word."""
    counts, flat = np.zeros(len(words), np.int64), []
    for k, raw in enumerate(words):
        word = raw.decode().strip().lower()
        if word.isalpha():
            own = {zlib.crc32(f"={word}".encode()) >> (32 - BITS)} | {zlib.crc32(word[:n].encode()) >> (32 - BITS) for n in PREFIXES if len(word) >= n}
            counts[k] = len(own)
            flat += own
    return counts, np.array(flat, np.uint32)


def features(texts: list[str], chosen: np.ndarray | None = None) -> list[np.ndarray]:
    """The set of features of each text; only chosen ones (a mask), if given."""
    table = _tables.setdefault(("features", BITS), WordTable(word_features))
    flat, counts = table.encode(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    if chosen is not None:
        keep = chosen[flat]
        flat, doc = flat[keep], doc[keep]
    key = np.unique(doc.astype(np.int64) << BITS | flat)
    doc, flat = key >> BITS, key & ((1 << BITS) - 1)
    return np.split(flat, np.searchsorted(doc, np.arange(1, len(texts)))) if len(texts) else []


def choose(p: np.ndarray, u: np.ndarray, n: int, m: int, prior: float) -> np.ndarray:
    """Features that stand out in the n positive texts (p: counts) against the m unlabelled ones (u).

    Their share must be LEAST_LIFT times that of what is left of the unlabelled texts once the class prior's part of positive
    ones is taken out, and above the unlabelled share by more than chance would let any of the features be: by
    sqrt(2 ln features) standard errors, and by up to 8 with more texts.
    """
    pooled = (p + u + 1) / (n + m + 2)
    z = (p / n - u / m) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    tried = p >= LEAST_TEXTS
    least = np.clip(0.2 * np.sqrt(n), np.sqrt(2 * np.log(max(2, np.count_nonzero(tried)))), 8)
    others = np.maximum(0, u / m - prior * p / n) / (1 - prior) + 0.5 / m
    return np.flatnonzero(tried & (z >= least) & (p / n >= LEAST_LIFT * others))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights of n features and intercept that minimise the non-negative risk, by Adam over all rows at once; a row is the list of its features."""
    w = np.append(np.zeros(n), np.log(prior / (1 - prior)))
    mean, square = np.zeros(n + 1), np.zeros(n + 1)

    def flat(rows: list[np.ndarray]):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), len(rows)

    def slopes(rows, *signs):  # for each sign the mean loss l(sign g) and its gradient
        row, column, size = rows
        g = np.bincount(row, w[column], size) + w[-1]
        for sign in signs:
            pull = -sign / (1 + np.exp(np.clip(sign * g, -50, 50))) / size
            yield np.logaddexp(0, -sign * g).mean(), np.append(np.bincount(column, pull[row], n), pull.sum())

    toxic, others = flat(positive), flat(unlabelled)
    for step in range(1, STEPS + 1):
        (_, as_positive), (loss_p, p_negative) = slopes(toxic, 1, -1)
        ((loss_u, u_negative),) = slopes(others, -1)
        rest, rest_slope = loss_u - prior * loss_p, u_negative - prior * p_negative
        grad = prior * as_positive + rest_slope if rest >= 0 else -rest_slope
        grad[:-1] += RIDGE * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w = w - RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def sample(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(kind, text) of the fitting sample, a table in the shared folder, and the class prior. No held-out row is in it, nor its label looked at.

    kind: 1 of toxic texts, 0 of unlabelled ones, which any document may be. Copies of a text count once in either, lest
    their common words pass for telling ones.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rows = documents.agg(F.count("*")).first()[0]
    part = lambda most, of, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, of)))
    positive = known.where("toxic = 1").where(part(MOST_POSITIVE, toxic, 3)).select("doc_id", F.lit(True).alias("toxic"))
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").where(~held_out())
    drawn = texts.join(F.broadcast(positive), "doc_id", "left").withColumn("drawn", part(MOST_UNLABELLED, rows, 4))  # about MOST_POSITIVE rows
    kinds = F.array_compact(F.array(F.when(F.col("toxic"), F.lit(1)), F.when(F.col("drawn"), F.lit(0))))
    drawn = drawn.where("toxic or drawn").select(F.explode(kinds).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    return written(drawn.dropDuplicates(["kind", "text"]).repartition(SAMPLE_TASKS), "toxicity-sample"), toxic / n if n else 0.0


def train(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(chosen features, their weights, intercept); without a toxic example nothing is toxic.

    Counts of features and then the chosen features of each text come to the driver; texts don't.
    """
    drawn, prior = sample(documents, labels)
    size = 1 << BITS

    def sets(batches: Iterator[pa.RecordBatch], mask: np.ndarray | None) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for batch in batches:
            texts, sizes = texts_of(batch.column(1))
            for i, j in chunks(sizes):
                yield batch.column(0).slice(i, j - i).to_numpy(), features(texts[i:j], mask)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + counting.SLICE), np.int64)  # the rows come last
        for kinds, rows in sets(batches, None):
            for kind in (0, 1):
                own = [x for k, x in zip(kinds, rows) if k == kind]
                if own:
                    total[kind, :size] += np.bincount(np.concatenate(own), minlength=size)
                    total[kind, size] += len(own)
        yield counting.sliced(total.ravel())

    total = counting.summed(drawn.mapInArrow(count, counting.SCHEMA), 2 * (size + counting.SLICE)).reshape(2, -1)
    if not total[1, size] or not 0 < prior < 1:
        return np.zeros(0, np.int64), np.zeros(0), 5.0 if prior == 1 else -5.0
    chosen = choose(total[1, :size], total[0, :size], int(total[1, size]), max(1, int(total[0, size])), prior)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(size, bool)
        mask[chosen] = True
        for kinds, rows in sets(batches, mask):
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary())], names=["kind", "features"])

    picked = drawn.mapInArrow(pick, struct(kind="int", features="binary")).toArrow()  # the sample's rows
    rows = sorted(zip(picked["kind"].to_pylist(), picked["features"].to_pylist()))  # the same fit, in whatever order they come
    positive, unlabelled = ([np.searchsorted(chosen, np.frombuffer(x, "<u4")) for k, x in rows if k == kind] for kind in (1, 0))
    weights, intercept = fit(positive, unlabelled or [np.zeros(0, np.int64)], len(chosen), prior)
    return chosen, weights, intercept


def toxicity(documents: DataFrame, labels: DataFrame, scored: DataFrame | None = None, carried: bool = False) -> DataFrame:
    """Scores every whole text of documents(doc_id, text, ...), or of scored, if given, with a classifier fitted to documents.

    labels(doc_id, toxic, ...); of several labels of a doc_id the largest counts, null ones don't. Returns per row: doc_id,
    held_out (crc32 of the doc_id as text has remainder 1 by 3; a null doc_id counts as an empty text), score (0 to 1),
    predicted (1 from THRESHOLD); with carried, the whole row besides, as a struct named row. Null and empty texts get the
    score of a text without features. Repeated rows are scored each; other columns are ignored; an empty table gives no rows.
    """
    with scratch(documents.sparkSession):
        chosen, weights, intercept = train(documents, labels)
    model = {"at": chosen.astype(np.int32), "weights": weights}
    scored = documents if scored is None else scored
    own = scored.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"), *([F.struct(*scored.columns).alias("row")] if carried else []))
    schema = struct(doc_id="long", held_out="boolean", score="double", predicted="int")
    if carried:
        schema = schema.add("row", own.schema["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, mask = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weight[model["at"]], mask[model["at"]] = model["weights"], True
        for batch in batches:
            texts, sizes = texts_of(batch.column(2))
            for i, j in chunks(sizes):
                g = np.array([weight[x].sum() for x in features(texts[i:j], mask)]) + intercept
                score = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *([batch.column(3).slice(i, j - i)] if carried else [])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(run, schema)
