"""Ranked lexical search with block-max pruning.

The index is a table of blocks. A block is a range of documents of like length (within the run of texts that a task reads at
once), of about BLOCK_TERMS terms together; a longer document is a block of its own. A block's row holds its distinct terms,
its forward index - each document's terms and how often it has them - and, for each term, the greatest frequency and the
shortest document that has it, whose score bounds every score of the term in the block.

A search goes over the blocks twice, where they lie. The first time each task scores, for each query, the block of the
highest bound among those that it reads; the last of the best scores found is a threshold that no better answer falls below.
The second time each task sorts its blocks by each query's bound and scores their forward indexes until the bound drops below
the threshold, which rises with what the task finds. So only first places are shuffled, and neither postings nor bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm.runs import gathered, numbers, planes, rested, runs, slices
from folioquery.llm.shared import scratch, struct, written

TOP = 20
#: Bytes of texts whose documents are put in order of their length; terms of a block; blocks whose bounds a task holds.
RUN_BYTES, BLOCK_TERMS, HELD_BLOCKS = 2 << 20, 4096, 256
#: Bytes of the queries' texts that go to every task at once; more are searched in as many turns as it takes.
QUERY_BYTES = 8 << 20
#: Bytes of terms.
TERM = np.zeros(256, bool)
TERM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
TERM[0x80:] = True

BLOCKS = "n_docs long, n_terms long, docs binary, known binary, sizes binary, starts binary, terms binary, counts binary, words binary, ends binary, df binary, most binary, shortest binary"


def build_index(documents: DataFrame, run_bytes: int = RUN_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The index of documents(doc_id, text, ...) as a table in the shared folder, a row for each block; texts without a term are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in gathered(batches, 1, run_bytes):
            raw, start, end, doc = runs(texts, TERM)
            if not len(start):
                continue
            coded = slices(raw, start, end).dictionary_encode()
            size = np.bincount(doc, minlength=len(texts))
            order = np.argsort(size, kind="stable")
            order = order[size[order] > 0]
            place = np.zeros(len(texts), np.int64)
            place[order] = np.arange(len(order))
            many = np.int64(len(coded.dictionary))
            key, counts = np.unique(place[doc] * many + coded.indices.to_numpy(), return_counts=True)
            of_doc, of_term = key // many, key % many
            sizes, ids, known = size[order], rows.column(0).fill_null(0).to_numpy()[order], rows.column(0).is_valid().to_numpy(zero_copy_only=False)[order]
            # A block ends where the next document would take it over the number of terms.
            bounds, total = [0], np.append(0, np.cumsum(sizes))
            while bounds[-1] < len(sizes):
                bounds.append(max(bounds[-1] + 1, int(np.searchsorted(total, total[bounds[-1]] + block_terms, "right")) - 1))
            edges = np.searchsorted(of_doc, bounds)
            out: list[tuple] = []
            for i, j, a, b in zip(bounds, bounds[1:], edges, edges[1:]):
                distinct, local = np.unique(of_term[a:b], return_inverse=True)
                most, shortest = np.zeros(len(distinct), np.int64), np.full(len(distinct), np.iinfo(np.int64).max)
                np.maximum.at(most, local, counts[a:b])
                np.minimum.at(shortest, local, sizes[of_doc[a:b]])
                words = coded.dictionary.take(pa.array(distinct))
                ends = np.cumsum(pc.binary_length(words).to_numpy())
                out.append((
                    j - i, int(total[j] - total[i]), planes(ids[i:j].astype(np.int64)), known[i:j].tobytes(), planes(sizes[i:j].astype(np.uint32)),
                    planes(np.searchsorted(of_doc[a:b], np.arange(i, j + 1)).astype(np.uint32)), planes(local.astype(np.uint32)), planes(counts[a:b].astype(np.uint32)),
                    b"".join(words.to_pylist()), planes(ends.astype(np.uint32)), planes(np.bincount(local, minlength=len(distinct)).astype(np.uint32)), planes(most.astype(np.uint32)), planes(shortest.astype(np.uint32)),
                ))
            kinds = [pa.int64()] * 2 + [pa.binary()] * 11
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 64]), kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])
            rested()

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return written(texts.mapInArrow(run, BLOCKS), "search-index")


class Terms:
    """The terms of some queries: number of each, and for each term the queries that have it and how often."""

    def __init__(self, texts: list[bytes]):
        raw, start, end, of = runs(texts, TERM)
        coded = slices(raw, start, end).dictionary_encode()
        self.texts = len(texts)
        self.words: list[bytes] = coded.dictionary.to_pylist()
        key, self.times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(texts)) + of, return_counts=True)
        self.query = key % max(1, len(texts))
        self.start = np.searchsorted(key // max(1, len(texts)), np.arange(len(self.words) + 1))

    def numbers(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


def words_of(blob: bytes, ends: bytes) -> list[bytes]:
    bounds = np.append(0, numbers(ends, "<u4")).tolist()
    return [blob[i:j] for i, j in zip(bounds, bounds[1:])]


def frequencies(index: DataFrame, terms: Terms) -> np.ndarray:
    """How many documents hold each of the terms."""
    words = terms.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = {w: k for k, w in enumerate(words)}, np.zeros(len(words), np.int64)
        for batch in batches:
            for blob, ends, df in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.array([number.get(w, -1) for w in words_of(blob, ends)], np.int64)
                total[at[at >= 0]] += numbers(df, "<u4")[at >= 0]  # a block's terms are distinct
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(len(words), np.int64)
    for term, df in index.select("words", "ends", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # terms of the queries
        out[term] = df
    return out


class Scorer:
    """Bounds and scores of some queries in blocks; integers only, but for the terms' weights."""

    def __init__(self, terms: Terms, df: np.ndarray, n: int, length: int):
        self.n, self.length, self.queries = n, length, terms.texts
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        self.number = terms.numbers()
        self.start, self.query = terms.start, terms.query
        self.weight = np.repeat(weight, np.diff(terms.start)) * terms.times

    def shares(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a term of that frequency in a document of that size has for its weight."""
        m = 100 - 25 + (25 * size.astype(np.int64) * self.n) // self.length
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def asked(self, blob: bytes, ends: bytes) -> np.ndarray:
        """The number of each of a block's terms among those of the queries, else -1."""
        get = self.number.get
        return np.array([get(w, -1) for w in words_of(blob, ends)], np.int64)

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term all that have it: (which of the terms, the place among all pairs of term and query)."""
        count = self.start[term + 1] - self.start[term]
        ends = np.cumsum(count)
        own = np.repeat(np.arange(len(term)), count)
        return own, np.arange(len(own)) + np.repeat(self.start[term] - (ends - count), count)

    def bounds(self, asked: np.ndarray, most: bytes, shortest: bytes) -> np.ndarray:
        """For each query what no score in the block exceeds."""
        out = np.zeros(self.queries, np.int64)
        at = np.flatnonzero(asked >= 0)
        share = self.shares(numbers(most, "<u4")[at], numbers(shortest, "<u4")[at])
        own, place = self.pairs(asked[at])
        np.add.at(out, self.query[place], self.weight[place] * share[own])
        return out

    def scores(self, row: dict, asked: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place of the document in the block, score) of the wanted queries (a mask), from the block's forward index."""
        starts, terms = numbers(row["starts"], "<u4").astype(np.int64), asked[numbers(row["terms"], "<u4")]
        sizes = numbers(row["sizes"], "<u4")
        doc = np.repeat(np.arange(len(sizes)), np.diff(starts))
        at = np.flatnonzero(terms >= 0)
        share = self.shares(numbers(row["counts"], "<u4")[at], sizes[doc[at]])
        own, place = self.pairs(terms[at])
        some = wanted[self.query[place]]
        own, place = own[some], place[some]
        total = np.zeros(self.queries * len(sizes), np.int64)
        np.add.at(total, self.query[place] * len(sizes) + doc[at][own], self.weight[place] * share[own])
        found = np.flatnonzero(total > 0)
        return found // len(sizes), found % len(sizes), total[found]


class Best:
    """For each query the first places among what it is given: higher scores first, then smaller ids, null ones last."""

    def __init__(self, queries: int, top: int):
        self.queries, self.top = queries, top
        self.rows = np.zeros((4, 0), np.int64)  # query, score, whether the id is null, id

    def add(self, *rows: np.ndarray) -> None:
        every = np.concatenate([self.rows, np.stack(rows)], axis=1)
        order = np.lexsort((every[3], every[2], -every[1], every[0]))
        query = every[0, order]
        rank = np.arange(len(order)) - np.searchsorted(query, query)
        self.rows = every[:, order[rank < self.top]]

    def last(self) -> np.ndarray:
        """The score of each query's last place, 1 where places are free."""
        count = np.bincount(self.rows[0], minlength=self.queries)
        out = np.ones(self.queries, np.int64)
        full = np.flatnonzero(count >= self.top)
        out[full] = self.rows[1, np.cumsum(count)[full] - 1]
        return out


def visited(scorer: Scorer, top: int, floor: np.ndarray | None, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work on its blocks. floor: thresholds to begin with; without them, each query scores one block of each run of blocks alone."""

    def close(rows: list[dict], best: Best) -> None:
        asked = [scorer.asked(r["words"], r["ends"]) for r in rows]
        bound = np.stack([scorer.bounds(a, r["most"], r["shortest"]) for a, r in zip(asked, rows)])
        order = np.argsort(-bound, axis=0, kind="stable")  # each query's blocks by their bounds
        left = np.ones(bound.shape, bool)
        for place in range(len(rows) if floor is not None else 1):
            at = order[place], np.arange(scorer.queries)
            least = best.last() if floor is None else np.maximum(best.last(), floor)
            live = bound[at] >= least  # equal scores may still win by their ids
            if not live.any():
                break
            live &= left[at]
            got = []
            for block in np.unique(order[place, live]):
                # Once a block is opened, all queries that can't leave it out are scored.
                wanted = live & (order[place] == block) if floor is None else left[block] & (bound[block] >= least)
                left[block] &= ~wanted
                query, doc, score = scorer.scores(rows[block], asked[block], wanted)
                keep = score >= least[query]
                query, doc, score = query[keep], doc[keep], score[keep]
                got.append((query, score, ~np.frombuffer(rows[block]["known"], bool)[doc], numbers(rows[block]["docs"], "<i8")[doc]))
            if got:
                best.add(*map(np.concatenate, zip(*got)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = Best(scorer.queries, top), []
        for batch in batches:
            rows += batch.to_pylist()
            while len(rows) >= held:
                close(rows[:held], best)
                rows = rows[held:]
        if rows:
            close(rows, best)
        query, score, null, doc = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["query", "doc_id", "score"])

    return run


def first_places(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(index: DataFrame, texts: list[bytes], n: int, length: int, top: int, held: int) -> DataFrame:
    """(query, rank, doc_id, score) of some queries, by their places in texts."""
    terms = Terms(texts)
    scorer = Scorer(terms, frequencies(index, terms), n, length)
    columns = ["docs", "known", "sizes", "starts", "terms", "counts", "words", "ends", "most", "shortest"]
    kind = "query long, doc_id long, score long"
    floor = np.ones(len(texts), np.int64)
    seen = first_places(index.select(*columns).mapInArrow(visited(scorer, top, None, held), kind), top)
    for query, score in seen.where(F.col("rank") == top).select("query", "score").collect():  # a row for each query
        floor[query] = score
    return first_places(index.select(*columns).mapInArrow(visited(scorer, top, floor, held), kind), top)


def turns(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The queries in turns of about so many bytes: they are read one partition at a time."""
    held, size = [], 0
    for item, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary")).toLocalIterator():
        held.append((item, bytes(text or b"")))
        size += len(held[-1][1]) + 16
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(documents: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES, block_terms: int = BLOCK_TERMS, held: int = HELD_BLOCKS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The top documents(doc_id, text, ...) for each of items(item_id, text, ...): item_id, rank, doc_id, score.

    Terms are the longest runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; null and empty texts
    have none and are neither counted nor found. Ranks go by score, the larger first, then by doc_id, the smaller first, null
    ones last. Each row is a document of its own, and each item's row a query of its own, so rows that repeat are found and
    answered each. Long texts count whole; other columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    kind = struct(item_id="long", rank="int", doc_id="long", score="long")
    with scratch(spark):
        index = build_index(documents, run_bytes, block_terms)
        n, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        found = []
        for turn in turns(items, query_bytes) if n else []:
            ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(turn)], "query long, item_id long")  # a turn's queries
            own = ranked(index, [t for _, t in turn], n, length, top, held)
            found.append(written(own.join(F.broadcast(ids), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-results", keep=1))
        out = spark.createDataFrame([], kind)
        for part in found:
            out = out.unionByName(part)
        return out
