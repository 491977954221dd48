"""Words as runs of bytes of UTF-8, found by array operations over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z in lower case, by byte; bytes of longer characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def runs(texts: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes of texts, a line feed after each; start and end of each maximal run of bytes marked in word; the run's text).

    word: 256 marks; a line feed has none, so no run goes beyond its text.
    """
    raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    marked = word[raw]
    edges = np.flatnonzero(np.diff(marked, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return raw, start, end, np.searchsorted(ends, start, "right")


def slices(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """raw[start:end] of each run, which don't overlap, in order, as a binary array."""
    if not len(start):
        return pa.array([], pa.large_binary())
    bounds = np.empty(2 * len(start), np.int64)
    bounds[::2], bounds[1::2] = start, end
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    return every.take(pa.array(np.arange(0, len(bounds) - 1, 2)))


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as their bytes, all lowest ones first, and so on: high bytes are mostly zero, and long runs of zeros cost nothing when compressed."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def numbers(blob: bytes, kind: str) -> np.ndarray:
    """What planes() made of numbers of a kind, such as "<i8"."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def rested() -> None:
    """Gives the memory back that Arrow keeps for later, between two pieces of work: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()


def gathered(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in runs of about so many bytes of text, one row at least: (the rows, their texts; null is empty)."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        own = [t or b"" for t in batch.column(text).cast(pa.large_binary()).to_pylist()]
        first = 0
        for k, t in enumerate(own):
            size += len(t)
            if size >= most:
                held.append(batch.slice(first, k + 1 - first))
                texts += own[first : k + 1]
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
                held, texts, size, first = [], [], 0, k + 1
        if first < len(own):
            held.append(batch.slice(first))
            texts += own[first:]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
