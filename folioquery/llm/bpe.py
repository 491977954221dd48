"""Byte-level BPE by merge replay over distinct words.

A merge inside one word never depends on another word. So the corpus' merges are replayed part by part: a task takes a run
of texts of bounded size, and of their distinct words those that its worker hasn't met yet. It keeps an inverted index from
the rank of a token pair to the positions in all these words where the pair stands, and applies the merges in rank order to
all positions at once, updating only the neighbours of what it merged. A worker remembers the ids of KNOWN_WORDS words.
The ids are those of one replay over the whole corpus, without a shuffle or a broadcast, whatever its vocabulary's size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.pretok import WordTable, _tables, chunks, texts_of
from folioquery.llm.shared import struct

NONE = -1


class Ranks:
    """Merge ranks of a .tiktoken file: a token's rank is its id, and two neighbours merge if their bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, to, unsafe = [], [], np.zeros(self.size, bool)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    to.append(rank)
                    # Making a (or b) can bring about a pair of lower rank, which then has to go first.
                    unsafe[a] |= a > rank and k > 1
                    unsafe[b] |= b > rank and len(token) - k > 1
        order = np.argsort(keys)
        self.keys, self.to, self.unsafe = np.array(keys, np.int64)[order], np.array(to, np.int64)[order], unsafe
        self.tokens = np.empty(self.size, object)
        self.tokens[:] = b""
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], NONE)


class Replay:
    """Symbols of distinct words with links to their neighbours, and the inverted index from a pair's rank to positions."""

    def __init__(self, words: list[bytes], ranks: Ranks):
        self.ranks = ranks
        data = np.frombuffer(b"".join(words), np.uint8)
        self.n, self.sizes = len(data), np.fromiter(map(len, words), np.int64, len(words))
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.symbol = ranks.byte[data]
        self.alive = np.ones(self.n, bool)
        self.next, self.previous = np.arange(1, self.n + 1), np.arange(-1, self.n - 1)
        ends = np.cumsum(self.sizes)
        self.next[ends[self.sizes > 0] - 1] = NONE
        self.previous[(ends - self.sizes)[self.sizes > 0]] = NONE
        self.index: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.file(np.flatnonzero(self.next != NONE))

    def file(self, at: np.ndarray) -> None:
        """Files the pairs that start at these positions under their ranks."""
        if not len(at):
            return
        rank = self.ranks.of_pairs(self.symbol[at], self.symbol[self.next[at]])
        at, rank = at[rank != NONE], rank[rank != NONE]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.append(0, cut)].tolist(), np.split(at, cut)):
            if r in self.index:
                self.index[r].append(part)
            else:
                self.index[r] = [part]
                heapq.heappush(self.heap, r)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words)"""
        while self.heap:
            rank = heapq.heappop(self.heap)
            lists = self.index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[self.alive[at] & (self.next[at] != NONE)]
            at = at[self.ranks.of_pairs(self.symbol[at], self.symbol[self.next[at]]) == rank]
            if not len(at):
                continue
            if self.ranks.unsafe[rank]:
                first = np.append(True, self.word[at[1:]] != self.word[at[:-1]])
                later, at = at[~first], at[first]
            else:
                # Of pairs that overlap, every other one merges, from the left.
                follows = np.append(False, self.next[at[:-1]] == at[1:])
                head = np.flatnonzero(~follows)
                in_run = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                later, at = at[:0], at[in_run % 2 == 0]
            gone = self.next[at]
            after = self.next[gone]
            self.symbol[at] = rank
            self.alive[gone] = False
            self.next[at] = after
            has = after != NONE
            self.previous[after[has]] = at[has]
            left = self.previous[at]
            self.file(np.unique(np.concatenate([left[left != NONE], at[has]])))
            if len(later):
                if rank in self.index:
                    self.index[rank].append(later)
                else:
                    self.index[rank] = [later]
                    heapq.heappush(self.heap, rank)
        return np.bincount(self.word[self.alive], minlength=len(self.sizes)), self.symbol[self.alive].astype(np.uint32)


def coder(path: str) -> tuple[WordTable, Ranks]:
    if ("ranks", path) not in _tables:
        ranks = Ranks(path)
        _tables[("ranks", path)] = WordTable(lambda words: Replay(words, ranks).run()), ranks
    return _tables[("ranks", path)]


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text."""
    flat, counts = coder(path)[0].encode(texts)
    return np.split(flat, np.cumsum(counts)[:-1]) if len(texts) else []


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    return b"".join(coder(path)[1].tokens[ids].tolist())


def encode(documents: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Encodes and decodes every whole text of documents(doc_id, text, ...); path is a .tiktoken rank file.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers; only if with_ids), ids_sha256, decoded_sha256.
    A null text is an empty one: no ids. Repeated rows are each encoded. Other columns are ignored, whatever their names;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = texts_of(batch.column(1))
            for i, j in chunks(sizes):
                own = encode_texts(texts[i:j], path)
                coded = [x.astype("<u4").tobytes() for x in own]
                columns = [batch.column(0).slice(i, j - i), pa.array([len(x) for x in own], pa.int64())]
                if with_ids:
                    columns.append(pa.array(coded, pa.binary()))
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in coded]))
                columns.append(pa.array([hashlib.sha256(decode_ids(x, path)).hexdigest() for x in own]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    fields = {"doc_id": "long", "n_tokens": "long", "ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = struct(**{k: v for k, v in fields.items() if with_ids or k != "ids"})
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
