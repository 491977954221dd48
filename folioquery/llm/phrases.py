"""Collocations by hierarchical pair naming.

Words are named first: each (lang, word) that occurs often enough gets a number. Then, level by level, two adjacent names of
phrases of k - 1 words (which overlap in k - 2 words) are a pair, and each pair that occurs often enough gets a number of its
own, which stands for a phrase of k words. A pair is named once for the whole corpus: blocks of texts send their distinct
pairs, with counts, to the bucket of the pair's hash; the bucket adds them up and answers each block with the numbers. The
two halves of a pair are its parent pointers: a phrase's words, the counts of all its beginnings and ends, and the shorter
phrases that it covers are found by joins along them.

A block only ever sends what is distinct in it, so that a word or pair of any frequency is one entry for each block. A
bucket holds about ENTRIES entries, whatever the size of the corpus; their number follows from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.llm.runs import gathered, numbers, planes, rested, runs, slices
from folioquery.llm.shared import scratch, struct, written

LEAST, WORDS, TOP, COVERED = 10, 3, 2000, 50
#: Bytes of texts of a block, entries of a bucket.
BLOCK_BYTES, ENTRIES = 4 << 20, 1_000_000
#: First places are found among so many parts of a lang's phrases, then among their first places.
PARTS = 64
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
WORD, BREAK = np.ones(256, bool), np.zeros(256, bool)
WORD[list(BLANKS + BREAKS)] = False
BREAK[list(BREAKS)] = True

SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("ends", pa.binary()), ("counts", pa.binary())])
NAMED = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("at", pa.binary()), ("ids", pa.binary()),
    ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("first", pa.int64()), ("rest", pa.int64()), ("f", pa.int64()),
])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{c.name} {kinds[c.type]}" for c in schema)


def named_rows(id: np.ndarray, f: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of NAMED, with nulls in the other columns."""
    own = {"id": pa.array(id, pa.int64()), "f": pa.array(f, pa.int64())} | columns
    return pa.RecordBatch.from_arrays([own.get(c.name, pa.nulls(len(id), c.type)) for c in NAMED], schema=NAMED)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of each pair of numbers."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(keys: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))


def cut(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The part of each bucket in sorted hashes."""
    own = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    bounds = np.flatnonzero(np.diff(own, prepend=-1.0, append=-1.0)) if len(own) else np.zeros(1, np.int64)
    for i, j in zip(bounds, bounds[1:]):
        yield int(own[i]), slice(int(i), int(j))


def split(documents: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each block of texts: its words as a sequence of numbers from 1, with 0 between pieces; the distinct words, in order of their hashes; words by lang."""
    schema = struct(block="long", seq="binary", keys="binary", ends="binary", counts="binary", n_keys="long", langs="array<struct<lang:string,n:bigint>>")
    listed = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows, texts in gathered(batches, 0, block_bytes):
            raw, start, end, doc = runs(texts, WORD)
            coded, langs = slices(raw, start, end).dictionary_encode(), rows.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            distinct, local, counts = np.unique(lang * max(1, len(coded.dictionary)) + word, return_inverse=True, return_counts=True)
            of_lang, of_word = distinct // max(1, len(coded.dictionary)), distinct % max(1, len(coded.dictionary))
            heads = [len(x.encode()).to_bytes(4, "little") + x.encode() for x in names]
            keys = [heads[a] + b for a, b in zip(of_lang.tolist(), coded.dictionary.take(pa.array(of_word)).to_pylist())]
            order = np.argsort(word_hashes(keys), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(1, len(order) + 1)
            pieces = np.cumsum(BREAK[raw], dtype=np.int32)[start]
            apart = np.cumsum(np.diff(pieces, prepend=pieces[:1]) != 0)
            seq = np.zeros(len(word) + (int(apart[-1]) if len(apart) else 0), np.uint32)
            seq[np.arange(len(word)) + apart] = place[local]
            keys = [keys[k] for k in order]
            ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys))).astype(np.uint32)
            total = np.bincount(lang, minlength=len(names)).tolist()
            values = [block, planes(seq), b"".join(keys), planes(ends), planes(counts[order].astype(np.uint32)), len(keys), [{"lang": a, "n": n} for a, n in zip(names, total)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), listed]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=schema.names)
            block += 1
            rested()

    texts = documents.select(F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return texts.mapInArrow(run, schema)


def words_of(keys: bytes, ends: bytes) -> pa.Array:
    bounds = np.append(0, numbers(ends, "<u4")).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(keys)])


def word_slices(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each bucket gets of each block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, ends, counts in zip(*(c.to_pylist() for c in batch.columns)):
                counts, bounds = numbers(counts, "<u4"), np.append(0, numbers(ends, "<u4")).astype(np.int64)
                for bucket, part in cut(word_hashes(words_of(keys, ends).to_pylist()), buckets):
                    first, last = bounds[part.start], bounds[part.stop]
                    sizes = (bounds[part.start + 1 : part.stop + 1] - first).astype(np.uint32)
                    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "block": block, "keys": keys[first:last], "ends": planes(sizes), "counts": planes(counts[part])}], SENT)

    return blocks.select("block", "keys", "ends", "counts").mapInArrow(run, ddl(SENT))


def pairs(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent names of a block: (where pairs start, each one's number; the distinct pairs' halves and counts, both in order of the pairs' hashes)."""
    both = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    size = np.int64(len(ids) + 1)
    distinct, local, counts = np.unique(seq[both].astype(np.int64) * size + seq[both + 1], return_inverse=True, return_counts=True)
    halves = np.stack([ids[distinct // size - 1], ids[distinct % size - 1]]) if len(distinct) else np.zeros((2, 0), np.int64)
    order = np.argsort(mixed(*halves), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return both, place[local], halves[:, order], counts[order]


def pair_slices(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each bucket gets of each block's distinct pairs; blocks(block, seq, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, seq, ids in zip(*(c.to_pylist() for c in batch.columns)):
                _, _, halves, counts = pairs(numbers(seq, "<u4"), numbers(ids, "<i8"))
                for bucket, part in cut(mixed(*halves), buckets):
                    keys = planes(np.ascontiguousarray(halves[0, part])) + planes(np.ascontiguousarray(halves[1, part]))
                    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "block": block, "keys": keys, "ends": b"", "counts": planes(counts[part].astype(np.uint32))}], SENT)

    return blocks.select("block", "seq", "ids").mapInArrow(run, ddl(SENT))


def name(sent: DataFrame, least: int, paired: bool, last: bool) -> DataFrame:
    """Numbers for the keys of sent that occur least times, a row each (id > 0); and for each block and bucket the numbers of its keys, unless no level follows."""

    def close(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([numbers(c, "<u4") for *_, c in held]).astype(np.int64)
        if paired:
            halves = [np.split(np.frombuffer(keys, np.uint8), 2) for _, keys, _, _ in held]
            first, rest = (np.concatenate([numbers(h[k].tobytes(), "<i8") for h in halves]) for k in (0, 1))
            _, a = np.unique(first, return_inverse=True)
            other, b = np.unique(rest, return_inverse=True)
            _, one, of = np.unique(a * np.int64(len(other)) + b, return_index=True, return_inverse=True)
        else:
            words = pa.concat_arrays([words_of(keys, ends) for _, keys, ends, _ in held]).dictionary_encode()
            of, one = words.indices.to_numpy(zero_copy_only=False), np.arange(len(words.dictionary))
        total = np.zeros(len(one), np.int64)
        np.add.at(total, of, counts)
        often = np.flatnonzero(total >= least)
        id_of = np.zeros(len(one), np.int64)
        id_of[often] = (np.int64(bucket) << 32) + np.arange(1, len(often) + 1)
        if paired:
            yield named_rows(id_of[often], total[often], first=pa.array(first[one[often]]), rest=pa.array(rest[one[often]]))
        else:
            keys = words.dictionary.take(pa.array(often)).to_pylist()
            sizes = [int.from_bytes(k[:4], "little") for k in keys]
            yield named_rows(id_of[often], total[often], lang=pa.array([k[4 : 4 + n].decode() for k, n in zip(keys, sizes)], pa.string()), word=pa.array([k[4 + n :].decode("utf-8", "replace") for k, n in zip(keys, sizes)], pa.string()))
        if not last:
            bounds = np.cumsum([len(c) // 4 for *_, c in held])
            for (block, *_), own in zip(held, np.split(id_of[of], bounds[:-1])):
                at = np.flatnonzero(own)
                yield named_rows(np.zeros(1, np.int64), np.zeros(1, np.int64), block=pa.array([block]), bucket=pa.array([bucket], pa.int32()), at=pa.array([planes(np.append(len(own), at).astype(np.uint32))], pa.binary()), ids=pa.array([planes(own[at])], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield from close(now, held)
                    held = []
                    rested()
                now = bucket
                held.append(tuple(row))
        if held:
            yield from close(now, held)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ddl(NAMED))


def renamed(blocks: DataFrame, named: DataFrame, paired: bool) -> DataFrame:
    """blocks with the numbers that buckets gave to their words, or pairs, in the place of them: (block, seq, ids), seq counting ids from 1."""
    columns = ["block", "bucket", "seq", "ids", "at"]
    own = blocks.select("block", F.lit(-1).alias("bucket"), "seq", F.col("ids") if paired else F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("at"))
    answers = named.where("id = 0").select("block", "bucket", F.lit(None).cast("binary").alias("seq"), "ids", "at")

    def close(block: int, seq: np.ndarray, ids: np.ndarray | None, answers: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        got = [np.zeros(0, np.int64)]
        for values, at in answers:
            place = numbers(at, "<u4")
            part = np.zeros(int(place[0]), np.int64)
            part[place[1:]] = numbers(values, "<i8")
            got.append(part)
        id_of = np.concatenate(got)
        local = np.zeros(len(id_of) + 1, np.uint32)
        kept = np.flatnonzero(id_of)
        local[kept + 1] = np.arange(1, len(kept) + 1)
        if paired:
            both, number, _, _ = pairs(seq, ids)
            new = np.zeros(max(0, len(seq) - 1), np.uint32)
            new[both] = local[number + 1]
        else:
            new = local[seq]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([planes(new)], pa.binary()), pa.array([planes(id_of[kept])], pa.binary())], names=["block", "seq", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers = None, []
        for batch in batches:
            for block, bucket, seq, ids, at in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket == -1:
                    if now:
                        yield close(*now, answers)
                    now, answers = (block, numbers(seq, "<u4"), numbers(ids, "<i8") if paired else None), []
                else:
                    answers.append((ids, at))
        if now:
            yield close(*now, answers)

    return own.select(*columns).unionByName(answers.select(*columns)).repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, struct(block="long", seq="binary", ids="binary"))


def names(documents: DataFrame, words: int, least: int, block_bytes: int = BLOCK_BYTES, entries: int = ENTRIES) -> tuple[list[DataFrame], DataFrame]:
    """Tables of names by number of words, and (lang, n) of all words: (id, lang, word, f) of words, (id, first, rest, f) of longer phrases."""
    out: list[DataFrame] = []
    blocks = written(split(documents, block_bytes), "phrase-blocks")
    langs = written(blocks.select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")), "phrase-langs")
    keys, total = blocks.select("n_keys").join(F.broadcast(langs.agg(F.sum("n").alias("n")))).agg(F.sum("n_keys"), F.max("n")).first()
    for k in range(1, words + 1):
        buckets = 1 + int((keys if k == 1 else total) or 0) // entries
        sent = word_slices(blocks, buckets) if k == 1 else pair_slices(blocks, buckets)
        named = written(name(sent, least, k > 1, k == words), f"phrase-names-{k}")
        own = named.where("id > 0")
        out.append(own.select("id", "lang", "word", "f") if k == 1 else own.select("id", "first", "rest", "f"))
        if k < words:
            blocks = written(renamed(blocks, named, k > 1), f"phrase-blocks-{k}")
    return out, langs


def candidates(named: list[DataFrame], covered: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of phrases of two words and more that no longer one covers."""
    level = named[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    found = []
    for k, pairs_of in enumerate(named[1:], 2):
        first = level.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("begin"), "heads")
        rest = level.select(F.col("id").alias("rest"), "last", "tails")
        joined = pairs_of.join(first, "first").join(rest, "rest")
        level = joined.select(
            "id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
        )
        if k < len(named):
            level = written(level, f"phrase-level-{k}")
            longer = named[k].select(F.explode(F.array("first", "rest")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            own = level.join(longer, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f")))
        else:
            own = level
        exact = lambda x: x.cast("decimal(16,0)")
        cuts = F.array(*[
            F.struct(F.call_function("div", exact(F.col("f")) * exact(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)"), exact(F.col("heads")[j - 1]) * exact(F.col("tails")[k - j - 1])).alias("score"),
                     F.lit(j).alias("cut"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r"))
            for j in range(1, k)
        ])
        found.append(own.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def collocations(documents: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, covered: int = COVERED, block_bytes: int = BLOCK_BYTES, entries: int = ENTRIES) -> DataFrame:
    """The first top phrases of 2 to words words of each lang of documents(text, lang, ...): lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; texts are cut at .,;:!? and line ends into pieces, and those at blanks and tabs into words. A phrase
    stands in one piece, occurs least times (a) and is dropped if a longer such phrase holds it and occurs covered per cent
    as often at least. score: floor(10^6 a a / (l r)) of its lowest cut, l and r the counts of the two parts, ties to the
    shorter first part; n: all words of the lang. Ranks go by score and a, the larger first, then by the phrase's bytes. A
    null text is empty, a null lang is `und`; rows that repeat count each; other columns are ignored; a table without words
    gives no rows.
    """
    with scratch(documents.sparkSession):
        named, langs = names(documents, words, least, block_bytes, entries)
        found = candidates(named, covered)
        order = [F.desc("score"), F.desc("a"), "phrase"]
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        few = found.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        out = ranked.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return written(out, "phrases", keep=1)
