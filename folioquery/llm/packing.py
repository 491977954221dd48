"""Lexical retrieval packing of documents into fixed windows of token ids.

Each task indexes bounded shards of its split: a BM25 inverted index from token id to documents. A seed document opens a
window; its rarest terms retrieve unused neighbours, best first, which fill the window; the one that reaches the end is cut,
and what is left of it stays a candidate. No shuffle takes place and every shard is bounded, so no group is ever gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.pretok import chunks, library_encoder, texts_of
from folioquery.llm.shared import struct

WINDOW, END_ID = 1024, 0
#: Ids of a shard of the index; the shard that this fills is packed and forgotten.
SHARD_IDS = 2_000_000
#: Parameters of the retrieval, not of what is packed: terms of a seed's query (its rarest that another document has, too),
#: and neighbours that one look-up returns; while the window has room, it is asked again without those used meanwhile.
QUERY_TERMS, NEIGHBOURS = 12, 32
K1, B = 1.2, 0.75


class Bm25:
    """Inverted index of a shard: for each term the documents that hold it, with their BM25 weights."""

    def __init__(self, documents: list[np.ndarray]):
        n = len(documents)
        sizes = np.fromiter(map(len, documents), np.int64, n)
        doc = np.repeat(np.arange(n), sizes)
        key, tf = np.unique(np.concatenate(documents).astype(np.int64) * n + doc, return_counts=True)
        term, self.doc = key // n, key % n
        vocabulary = int(term[-1]) + 1
        df = np.bincount(term, minlength=vocabulary)
        self.start = np.append(0, np.cumsum(df))
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (sizes / max(1, sizes.mean()))[self.doc]))
        shared = df[term] > 1
        order = np.argsort(self.doc[shared], kind="stable")
        self.terms = term[shared][order]
        self.terms_start = np.append(0, np.cumsum(np.bincount(self.doc[shared], minlength=n)))

    def neighbours(self, seed: int, unused: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
        """Unused documents that share the seed's rarest terms, best first; ties to the earlier one."""
        terms = self.terms[self.terms_start[seed] : self.terms_start[seed + 1]]
        if not len(terms):
            return terms
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-self.idf[terms], QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(self.start[t], self.start[t + 1]) for t in terms]
        docs = np.concatenate([self.doc[s] for s in spans])
        weights = np.concatenate([self.weight[s] for s in spans])
        keep = unused[docs]
        docs, weights = docs[keep], weights[keep]
        if not len(docs):
            return docs
        found, place = np.unique(docs, return_inverse=True)
        score = np.bincount(place, weights)
        if len(found) > most:
            best = np.sort(np.argpartition(-score, most)[:most])
            found, score = found[best], score[best]
        return found[np.argsort(-score, kind="stable")]


def pack_shard(documents: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard; every window but the last is full."""
    out, sequence = [], 0
    begin = np.zeros(len(documents), np.int64)
    rest = np.fromiter(map(len, documents), np.int64, len(documents))
    for d in np.flatnonzero(rest >= window):  # a long document fills windows by itself; its end remains to be packed
        for _ in range(rest[d] // window):
            out.append((int(d), int(begin[d]), window, sequence, 0))
            begin[d] += window
            sequence += 1
        rest[d] %= window
    unused = rest > 0
    if not unused.any():
        return out
    index = Bm25(documents)
    seeds = np.argsort(-rest, kind="stable")
    shortest = len(seeds) - 1  # where no neighbour is left: the last of seeds that is unused

    def put(d: int, offset: int) -> int:
        n = int(min(rest[d], window - offset))
        out.append((int(d), int(begin[d]), n, sequence, offset))
        begin[d] += n
        rest[d] -= n
        unused[d] = rest[d] > 0
        return offset + n

    for seed in seeds:
        while unused[seed]:
            filled = put(seed, 0)
            while filled < window:
                near = index.neighbours(seed, unused)
                if not len(near):
                    break
                for d in near:
                    if filled == window:
                        break
                    filled = put(d, filled)
            while filled < window:
                while shortest >= 0 and not unused[seeds[shortest]]:
                    shortest -= 1
                if shortest < 0:
                    break
                filled = put(seeds[shortest], filled)
            sequence += 1
    return out


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Packs all documents(doc_id, text, ...) into sequences of at most window ids; tokenizer is a tokenizers file.

    A document's ids are those of its whole text, then END_ID; null and empty texts have that id only. Rows that repeat a
    doc_id are packed each for itself. Returns the pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with with_ids the ids (little-endian unsigned 32-bit). Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = library_encoder(tokenizer), TaskContext.get().partitionId() << 36
        held, ids, total = [], [], 0

        def flush():
            nonlocal first
            pieces = pack_shard(held, window)
            doc, start, length, sequence, offset = map(np.array, zip(*pieces))
            parts = [held[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces]
            columns = [pa.array(ids, pa.int64()).take(pa.array(doc)), start, length, np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)), np.fromiter(map(len, held), np.int64, len(held))[doc], sequence + first, offset]
            first += int(sequence.max()) + 1
            columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns] + [pa.array(parts, pa.binary())] * with_ids
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            texts, sizes = texts_of(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in chunks(sizes):
                flat, counts = encode(texts[i:j])
                for key, part in zip(keys[i:j], np.split(flat, np.cumsum(counts)[:-1])):
                    held.append(np.append(part, np.uint32(END_ID)))
                    ids.append(key)
                    total += len(held[-1])
                    if total >= SHARD_IDS:
                        yield flush()
                        held, ids, total = [], [], 0
        if held:
            yield flush()

    fields = {k: "long" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    schema = struct(**fields | ({"ids": "binary"} if with_ids else {}))
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
