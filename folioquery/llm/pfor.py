"""Token ids in files of patched frame-of-reference blocks.

A file holds, in ascending doc_id order, the ids of a range of documents:

    magic | blocks | block starts (uint64 each) | doc_id int64, has_id uint8, n_tokens int64 of each document | footer

A block holds BLOCK ids (the last one fewer): minimum uint32, width uint8, ids uint16, exceptions uint16, then the ids less
the minimum in width bits each, then positions (uint16) and whole values (uint32) of those that need more bits. The width is
that of a percentile of the block. Files are written under a name of the attempt and renamed, so that a task may run again.
"""

from __future__ import annotations

import struct as binary
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm.pretok import chunks, library_encoder, texts_of
from folioquery.llm.shared import filesystem, new_folder, struct, written

MAGIC, BLOCK, PERCENTILE, END_ID = b"FQPFOR01", 1024, 95, 0
HEAD, FOOT = binary.Struct("<IBHH"), binary.Struct("<QQQQ8s")
#: Blocks that are coded at once.
RUN = 256


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def pack(values: np.ndarray, w: int) -> np.ndarray:
    """The lowest w bits of each value, one after the other, lowest first; a row for each row. Eight values fill w bytes, each at its own shift."""
    kind = np.uint32 if w <= 25 else np.uint64
    eights = (values & np.uint32((1 << w) - 1)).astype(kind).reshape(len(values), -1, 8)
    out = np.zeros((w, *eights.shape[:2]), np.uint8)
    for k in range(8):
        at, shift = divmod(k * w, 8)
        own = eights[:, :, k] << kind(shift)
        for b in range((shift + w + 7) // 8):
            out[at + b] |= (own >> kind(8 * b)).astype(np.uint8)
    return np.moveaxis(out, 0, 2).reshape(len(values), -1)


def unpack(packed: np.ndarray, w: int) -> np.ndarray:
    """What pack() was given."""
    kind = np.uint32 if w <= 25 else np.uint64
    eights = np.ascontiguousarray(np.moveaxis(packed.reshape(len(packed), -1, w), 2, 0))
    out = np.empty((*eights.shape[1:], 8), np.uint32)
    for k in range(8):
        at, shift = divmod(k * w, 8)
        own = eights[at].astype(kind)
        for b in range(1, (shift + w + 7) // 8):
            own |= eights[at + b].astype(kind) << kind(8 * b)
        out[:, :, k] = (own >> kind(shift)) & kind((1 << w) - 1)
    return out.reshape(len(packed), -1)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of BLOCK ids; the last one may be shorter."""
    out = []
    for at in range(0, len(ids), RUN * BLOCK):
        part = ids[at : at + RUN * BLOCK].astype(np.uint32)
        n = -(-len(part) // BLOCK)
        sizes = np.full(n, BLOCK)
        sizes[-1] = len(part) - (n - 1) * BLOCK
        grid = np.append(part, np.full(n * BLOCK - len(part), part[-1])).reshape(n, BLOCK)
        low = grid.min(axis=1)
        rest = grid - low[:, None]
        rank = min(BLOCK - 1, BLOCK * percentile // 100)
        width = widths(np.partition(rest, rank, axis=1)[:, rank])
        far = rest > ((1 << width) - 1).astype(np.uint32)[:, None]
        packed: list[bytes] = [b""] * n
        for w in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == w)
            for k, row in zip(own, pack(rest[own], w)):
                packed[k] = row[: -(-int(sizes[k]) * w // 8)].tobytes()
        for k in range(n):
            where = np.flatnonzero(far[k][: sizes[k]])
            out.append(HEAD.pack(low[k], width[k], sizes[k], len(where)) + packed[k] + where.astype("<u2").tobytes() + rest[k][where].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks at starts (the end of the last one comes last)."""
    heads = [HEAD.unpack_from(data, s) for s in starts[:-1]]
    low, width, sizes, patches = map(np.array, zip(*heads))
    raw = np.frombuffer(data, np.uint8)
    grid = np.zeros((len(heads), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        full = np.zeros((len(own), BLOCK * w // 8), np.uint8)
        for row, k in enumerate(own):
            n, at = -(-int(sizes[k]) * w // 8), int(starts[k]) + HEAD.size
            full[row, :n] = raw[at : at + n]
        grid[own] = unpack(full, w)
    for k in np.flatnonzero(patches):
        n, at = int(patches[k]), int(starts[k]) + HEAD.size + -(-int(sizes[k]) * int(width[k]) // 8)
        grid[k, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    grid += low.astype(np.uint32)[:, None]
    return grid.ravel()[: int(sizes.sum())] if (sizes[:-1] == BLOCK).all() else np.concatenate([g[:s] for g, s in zip(grid, sizes)])


class Writer:
    """Writes a file as the documents come; only a run of blocks and the documents' table are held."""

    def __init__(self, stream):
        self.stream, self.at, self.starts, self.docs, self.held, self.n_held, self.n_ids = stream, len(MAGIC), [], [], [], 0, 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= RUN * BLOCK:
            self.flush(self.n_held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        whole = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for block in encode_blocks(whole[:n]) if n else []:
            self.starts.append(self.at)
            self.at += len(block)
            self.stream.write(block)
        self.held, self.n_held = [whole[n:]], len(whole) - n

    def close(self) -> int:
        self.flush(self.n_held)
        end = self.at
        self.stream.write(np.array([*self.starts, end], "<u8").tobytes())
        self.stream.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self.stream.write(np.array([d is not None for d, _ in self.docs], np.uint8).tobytes())
        self.stream.write(np.array([n for _, n in self.docs], "<i8").tobytes())
        self.stream.write(FOOT.pack(end, len(self.starts), len(self.docs), self.n_ids, MAGIC))
        self.stream.close()
        return end + 8 * (len(self.starts) + 1) + 17 * len(self.docs) + FOOT.size


class Reader:
    """Reads a file: its documents' table and, through the index of block starts, any range of ids."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - FOOT.size)
        index, blocks, docs, self.n_ids, magic = FOOT.unpack(stream.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a file of token-id blocks")
        stream.seek(index)
        tail = stream.read(size - FOOT.size - index)
        self.starts = np.frombuffer(tail, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        key, has, self.counts = np.frombuffer(tail, "<i8", docs, at), np.frombuffer(tail, np.uint8, docs, at + 8 * docs), np.frombuffer(tail, "<i8", docs, at + 9 * docs)
        self.doc_ids = [k if h else None for k, h in zip(key.tolist(), has.tolist())]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        self.stream.seek(int(self.starts[a]))
        data = self.stream.read(int(self.starts[b] - self.starts[a]))
        return decode_blocks(data, self.starts[a : b + 1] - self.starts[a])[start - a * BLOCK : stop - a * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document, in order."""
        ends = np.cumsum(self.counts)
        for i, j in chunks(self.counts, most):
            first = int(ends[i - 1]) if i else 0
            part = self.ids(first, int(ends[j - 1]))
            for k in range(i, j):
                s = int(ends[k] - self.counts[k])
                yield self.doc_ids[k], s, part[s - first : int(ends[k]) - first]


def write(documents: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Encodes documents(doc_id, text, ...), appends END_ID to each and writes the files into folder, in doc_id order.

    Returns the manifest, a table in the shared folder: file_no, path, n_docs, n_ids, n_bytes, start (ids in the files
    before). Null and empty texts have END_ID only; rows without doc_id come first; rows that repeat a doc_id are kept, in
    the order of their texts' hashes. Other columns are ignored; an empty table gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = library_encoder(tokenizer), TaskContext.get()
        writer = None
        for batch in batches:
            texts, sizes = texts_of(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in chunks(sizes):
                if writer is None:
                    fs, where = filesystem(folder)
                    fs.create_dir(where, recursive=True)
                    path = f"{where}/part-{task.partitionId():06d}.pfor"
                    own = f"{path}.{task.taskAttemptId()}"
                    writer = Writer(fs.open_output_stream(own))
                flat, counts = encode(texts[i:j])
                for key, part in zip(keys[i:j], np.split(flat, np.cumsum(counts)[:-1])):
                    writer.add(key, np.append(part, np.uint32(END_ID)))
        if writer is not None:
            size = writer.close()
            fs.move(own, path)
            row = [task.partitionId(), f"{folder}/part-{task.partitionId():06d}.pfor", len(writer.docs), writer.n_ids, size]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=schema.names)

    schema = struct(file_no="long", path="string", n_docs="long", n_ids="long", n_bytes="long")
    # The hash splits a doc_id that many rows repeat, and orders its rows.
    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    manifest = written(ordered.select("doc_id", "text").mapInArrow(run, schema), "token-manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the files of a manifest: doc_id, start, n_tokens, ids_crc32 of each document, and its ids if with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = filesystem(row["path"])
                with fs.open_input_file(where) as stream:
                    rows = []
                    for doc_id, start, ids in Reader(stream, row["n_bytes"]).documents():
                        coded = ids.astype("<u4").tobytes()
                        rows.append([doc_id, row["start"] + start, len(ids), zlib.crc32(coded)] + [coded] * with_ids)
                        if len(rows) == 2000:
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)

    def table(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    fields = {k: "long" for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
    schema = struct(**fields | ({"ids": "binary"} if with_ids else {}))
    files = manifest.select("path", "n_bytes", "start")
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    return read(write(documents, tokenizer, new_folder(documents.sparkSession, "token-files")))
