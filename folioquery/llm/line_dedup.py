"""Line dedup by an exact set-similarity join.

A line is the set of its words, in lower case. Words are ordered from rare to frequent - by hashed counts over all lines; any
one order keeps the join exact. Two sets of Jaccard similarity 0.8 or more share a word within their prefixes, have like
sizes, and leave enough words behind the shared one's positions; besides, parities of their words' hashes differ in no more
places than the sets do.

1. Texts are read once for counts and keys: lines(doc_id, line, key), and from them each set's first line.
2. They are read once more for postings: for each prefix word of a set its key, size, position, parities and the prefix word
   before. A set's postings are made once a task. They travel packed, a row for what a task has for a partition, and the lists
   of equal words are met there by array operations; a set that two tasks met is one in a list. A frequent word's list is
   split by the next word that similar sets must share, which stands within few places of it.
3. Of each list, the sets that passed all filters with another one are verified, on their words. A pair whose words before
   the list's are the same is left to an earlier list, and a link counts in the list of the first word that both sets have, so
   it counts once. Large lists are verified in blocks.

Nothing is cut: lists, blocks and pairs are as many as the filters leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm import counting
from folioquery.llm.pretok import Words, chunks, texts_of
from folioquery.llm.shared import scratch, struct, written

SIMILAR_NUM, SIMILAR_DEN = 4, 5  # 0.8, in whole numbers
COUNTERS = 1 << 20
#: Smaller sets are similar to none but their own.
LEAST_SIZE = 4
#: A word is frequent from so many lines on; its list is split by the next shared word.
FREQUENT = 1 << 14
#: Sets of a block of a list, and their words; postings that a task holds before it passes them on.
BLOCK, BLOCK_WORDS, HELD = 2048, 1 << 17, 1 << 18
#: Words that are counted at once, and pairs of a list that are compared at once, besides those of one set.
COUNTED, PAIRS = 1 << 20, 1 << 16
#: Words that are looked up at once; sets of a list from which on they are compared by a matrix of words, and its cells.
LOOKED_UP, MANY, CELLS = 1 << 19, 24, 1 << 22
#: Bytes of text that are verified at once, besides what belongs to the group of the last of them.
VERIFIED = 1 << 20
CHUNK = 1 << 18
#: A set with more than one in SHARE of all lines is a hot one; there are fewer than SHARE of them. Their lines are dealt by SALTS.
SHARE, SALTS = 1000, 16
#: Bits of the filter for lines whose text is needed: so many for each, and at most.
BITS_A_LINE, MOST_BITS = 16, 1 << 26
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Sets of more words have parities in MORE numbers besides the first.
LONG, MORE = 56, 2
PARITIES = ["parities", *(f"more{k}" for k in range(MORE))]
#: The columns of postings.
POSTING = {"list": "<u4", "size": "<u4", "position": "<u4", "key": "<i8", "before": "<u8"} | dict.fromkeys(PARITIES, "<u8")
Postings = dict[str, np.ndarray]


def counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).view(np.int64)  # the first 20 bits


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def list_of(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """The list of a word, or of a frequent word and the next shared one. Lists of one number are met together, which does no harm."""
    return (mixed(first if second is None else first * np.uint64(3) ^ mixed(second)) >> np.uint64(32)).astype(np.uint32)


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that similar sets of these sizes share at least."""
    return -(-SIMILAR_NUM * (a + b) // (SIMILAR_NUM + SIMILAR_DEN))


class Sets:
    """The sets of words of lines, each in the order of rarity: hashes of all words, and where each line's begin and end."""

    def __init__(self, words: Words, lines: int, often: np.ndarray | None = None):
        # One number has line, rarity and the first bits of the hash; where that ties different words, the whole hash decides.
        bits = max(1, lines).bit_length()
        place = words.line.astype(np.uint64) << np.uint64(64 - bits) | words.hashes >> np.uint64(24 + bits)
        rarity = None if often is None else often.take(counter(words.hashes)).astype(np.uint64)
        if rarity is not None:
            place |= rarity << np.uint64(40 - bits)
        order = np.argsort(place)
        place, flat = place.take(order), words.hashes.take(order)
        new = np.append(True, place[1:] != place[:-1]) if len(flat) else np.zeros(0, bool)
        tied = np.flatnonzero(~new)
        if (flat[tied] != flat[tied - 1]).any():
            order = np.lexsort((words.hashes, words.line) if rarity is None else (words.hashes, rarity, words.line))
            line, flat = words.line[order], words.hashes[order]
            new = np.append(True, (line[1:] != line[:-1]) | (flat[1:] != flat[:-1]))
        self.order, self.flat = order[new], flat[new]
        self.line = words.line.take(self.order)
        self.size = np.bincount(self.line, minlength=lines)
        self.ends = np.cumsum(self.size)
        self.begin = self.ends - self.size
        self.position = np.arange(len(self.flat)) - self.begin[self.line]

    def keys(self) -> np.ndarray:
        """Two 64-bit sums over the words of each set, whatever their order."""
        sums = [np.append(np.uint64(0), np.cumsum(mixed(self.flat * np.uint64(odd) + np.uint64(odd)))) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        return np.stack([s[self.ends] - s[self.begin] for s in sums], 1).view(np.int64)

    def parities(self) -> list[np.ndarray]:
        """Of each set, which bits an odd number of its words' hashes has, in 64 slots; and in other 64 MORE slots for sets of more than LONG words, else zeros."""
        at = np.minimum(self.begin, len(self.flat))
        odd = lambda slots, some: np.where(some, np.bitwise_xor.reduceat(np.append(slots, np.uint64(0)), at), np.uint64(0)) if len(at) else np.zeros(0, np.uint64)
        out = [odd(np.uint64(1) << (self.flat & np.uint64(63)), self.size > 0)]
        slot, own = (self.flat >> np.uint64(6)) & np.uint64(63), ((self.flat >> np.uint64(12)) % np.uint64(MORE)).astype(np.int64)
        return out + [odd(np.where(own == k, np.uint64(1) << slot, np.uint64(0)), self.size > LONG) for k in range(MORE)]


def lines_of(documents: DataFrame) -> DataFrame:
    """doc_id, line (from 0), a, b (the key of its set; null without words) of each line; rows with a slice hold counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            texts, sizes = texts_of(batch.column(1))
            for i, j in chunks(sizes, CHUNK):
                words = Words(texts[i:j])
                n = int(words.n_lines.sum())
                sets = Sets(words, n)
                held.append(counter(sets.flat))
                if sum(map(len, held)) >= COUNTED:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held = []
                keys, none = sets.keys(), sets.size == 0
                doc = np.repeat(np.arange(j - i), words.n_lines)
                number = np.arange(n) - np.repeat(np.cumsum(words.n_lines) - words.n_lines, words.n_lines)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(keys[:, 0], mask=none), pa.array(keys[:, 1], mask=none), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=schema.names)
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        counts = counting.sliced(total)
        nulls = [pa.nulls(len(counts), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*nulls, *counts.columns], names=schema.names)

    schema = struct(doc_id="long", line="int", a="long", b="long", slice="int", counts="binary")
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def listed_words(sets: Sets, often: np.ndarray, chosen: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) places in sets of the words that name the lists of the chosen sets; a plain word stands in both.

    A word of many lines goes with each of the words that may be the next shared one.
    """
    spare = sets.size - -(-SIMILAR_NUM * sets.size // SIMILAR_DEN)  # words that a similar set may lack
    at = np.flatnonzero(chosen[sets.line] & (sets.position <= spare[sets.line]))
    frequent = often[counter(sets.flat[at])] >= many
    plain, hot = at[~frequent], at[frequent]
    room = spare[sets.line[hot]] + 1 - sets.position[hot]
    ends = np.cumsum(room)
    first = np.repeat(hot, room)
    return np.append(plain, first), np.append(plain, first + 1 + np.arange(len(first)) - np.repeat(ends - room, room))


def lists_of(sets: Sets, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = list_of(sets.flat[first])
    hot = np.flatnonzero(first != second)
    out[hot] = list_of(sets.flat[first[hot]], sets.flat[second[hot]])
    return out


def postings_of(sets: Sets, often: np.ndarray, chosen: np.ndarray, key: np.ndarray, many: int) -> Postings:
    """The postings of the chosen sets; a word of so many lines is frequent."""
    first, second = listed_words(sets, often, chosen, many)
    row = sets.line.take(second)
    before = second - 1
    before -= (before == first) & (first != second)
    out = {
        "list": lists_of(sets, first, second),
        "size": sets.size.astype(np.uint32).take(row),
        "position": (sets.position.take(second) - (first != second)).astype(np.uint32),
        "key": key.take(row),
        "before": np.where(before >= sets.begin.take(row), sets.flat[before], np.uint64(0)),
    }
    return out | {name: parities.take(row) for name, parities in zip(PARITIES, sets.parities())}


def apart(parities: list[np.ndarray], x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs' parities differ in no more places than `most` words could make them."""
    ok = np.bitwise_count(parities[0][x] ^ parities[0][y]) <= most
    at = np.flatnonzero(ok & (size_x > LONG) & (size_y > LONG))
    ok[at] = sum(np.bitwise_count(p[x[at]] ^ p[y[at]]).astype(np.int64) for p in parities[1:]) <= most[at]
    return ok


def similar_sizes(p: Postings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of postings, as places in p, may be of similar sets."""
    a, b = p["size"][x].astype(np.int64), p["size"][y].astype(np.int64)
    need = least_overlap(a, b)
    ok = apart([p[name] for name in PARITIES], x, y, a, b, a + b - 2 * need)
    ok &= np.minimum(a, b) * SIMILAR_DEN >= np.maximum(a, b) * SIMILAR_NUM
    ok &= np.minimum(a - p["position"][x], b - p["position"][y]) >= need
    before = p["before"][x]
    return ok & ((before != p["before"][y]) | (before == 0))


def place_of(lists: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for list and size; sizes ascend up to 2**18, beyond which they count as that."""
    return lists.astype(np.uint64) << np.uint64(32) | np.clip(size, 0, (1 << 18) - 1).astype(np.uint64) << np.uint64(14)


def candidates(p: Postings) -> np.ndarray:
    """Of lists in the order of list and size, which postings pass the filters with another one of their list.

    A set's size and position bound the sizes of those that may be similar, thus where they end behind it in the list, and
    how many places of the parities may differ.
    """
    found = np.zeros(len(p["list"]), bool)
    size = p["size"].astype(np.int64)
    most = (SIMILAR_DEN * size - (SIMILAR_NUM + SIMILAR_DEN) * p["position"].astype(np.int64)) // SIMILAR_NUM
    ends = np.searchsorted(place_of(p["list"], size), place_of(p["list"], most), "right")
    behind = np.maximum(ends - np.arange(len(size)) - 1, 0)
    differ = ((size + most) * (SIMILAR_DEN - SIMILAR_NUM) // (SIMILAR_NUM + SIMILAR_DEN)).clip(0, 64).astype(np.uint8)
    live = np.flatnonzero(behind)
    for i, j in chunks(behind[live], PAIRS):
        one, n = live[i:j], behind[live[i:j]]
        y = np.arange(1, n.sum() + 1) + np.repeat(one - (np.cumsum(n) - n), n)
        near = np.flatnonzero(np.bitwise_count(np.repeat(p["parities"][one], n) ^ p["parities"].take(y)) <= np.repeat(differ[one], n))
        x, y = np.repeat(one, n)[near], y[near]
        ok = similar_sizes(p, x, y)
        found[x[ok]] = found[y[ok]] = True
    return found


def listed(documents: DataFrame, often: np.ndarray) -> DataFrame:
    """list, a (key), blocks (of the list) of the sets that pass the filters with another one."""
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * tasks  # so that each task gets about as many

    def pack(held: list[Postings]) -> pa.RecordBatch:
        part = np.concatenate([rows["list"] for rows in held]) % np.uint32(parts)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        part = part[order]
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        columns = [np.concatenate([rows.pop(name) for rows in held]).take(order) for name in POSTING]  # what is held goes as its copy is made
        blobs = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(cut, cut[1:])]  # column by column, as they are compressed
        columns.clear()
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(np.diff(cut)), pa.array(blobs, pa.binary())], names=["part", "n", "blob"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[Postings] = []
        n_held = 0
        for batch in batches:
            texts, sizes = texts_of(batch.column(0))
            for i, j in chunks(sizes, CHUNK):
                words = Words(texts[i:j])
                sets = Sets(words, int(words.n_lines.sum()), often)
                keys = np.ascontiguousarray(sets.keys())
                first = np.zeros(len(keys), bool)
                for k in np.flatnonzero(sets.size >= LEAST_SIZE).tolist():
                    if (name := keys[k].tobytes()) not in seen:
                        seen.add(name)
                        first[k] = True
                held.append(postings_of(sets, often, first, keys[:, 0], FREQUENT))
                n_held += len(held[-1]["list"])
                if n_held >= HELD:
                    yield pack(held)
                    held, n_held = [], 0
        if n_held:
            yield pack(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {name: [] for name in POSTING}
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = 0
                for name, kind in POSTING.items():
                    held[name].append(np.frombuffer(blob, kind, n, at))
                    at += n * np.dtype(kind).itemsize
        if held["list"]:
            column = {name: np.concatenate(held.pop(name)) for name in POSTING}
            place = place_of(column["list"], column["size"]) | (column["key"] & 0x3FFF).astype(np.uint64)
            order = np.argsort(place)  # a set that isn't beside its own copy is met with it, which does no harm
            lists, keys = column["list"].take(order), column["key"].take(order)
            new = np.append(True, (lists[1:] != lists[:-1]) | (keys[1:] != keys[:-1]))
            order, lists = order[new], lists[new]
            beside = lists[1:] == lists[:-1]
            order = order[np.append(False, beside) | np.append(beside, False)]
            rows = {name: column.pop(name).take(order) for name in POSTING}
            some = np.flatnonzero(candidates(rows))
            own = {name: rows[name].take(some) for name in ("list", "key", "size")}
            _, place, n = np.unique(own["list"], return_inverse=True, return_counts=True)
            blocks = np.maximum(-(-n // BLOCK), -(-np.bincount(place, own["size"], len(n)).astype(np.int64) // BLOCK_WORDS))[place]
            for k in range(0, len(some), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(own["list"][part].astype(np.int64)), pa.array(own["key"][part]), pa.array(blocks[part].astype(np.int32))], names=["list", "a", "blocks"])

    dealt = documents.select("text").mapInArrow(make, struct(part="int", n="long", blob="binary")).repartition(tasks, "part")
    return dealt.mapInArrow(meet, struct(list="long", a="long", blocks="int"))


def line_slot(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(mixed(doc.astype(np.uint64)) + line.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def texts_of_lines(documents: DataFrame, needed: DataFrame) -> DataFrame:
    """doc_id, line, text of the lines in needed(doc_id, line), and of a few others that share a bit of a filter with them."""
    rows = needed.count()
    bits = 1 << max(15, min(MOST_BITS, BITS_A_LINE * rows).bit_length() - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = line_slot(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            np.bitwise_or.at(total, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].view(np.int64))], names=["word", "bits"])

    found = needed.select(F.coalesce("doc_id", F.lit(0)), "line").mapInArrow(mark, struct(word="long", bits="long")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = texts_of(batch.column(1))
            keys, docs = batch.column(0), batch.column(0).fill_null(0).to_numpy()
            for i, j in chunks(sizes, CHUNK):
                split = [t.split("\n") for t in texts[i:j]]
                counts = np.fromiter(map(len, split), np.int64, j - i)
                doc = np.repeat(np.arange(i, j), counts)
                line = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = line_slot(docs[doc], line, bits)
                own = np.flatnonzero(table[at >> 6] >> (at & 63) & 1)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[own])), pa.array(line[own].astype(np.int32)), pa.array([split[doc[k] - i][line[k]] for k in own.tolist()], pa.string())], names=["doc_id", "line", "text"])

    return documents.select("doc_id", "text").mapInArrow(pick, struct(doc_id="long", line="int", text="string"))


def verified(rows: DataFrame, often: np.ndarray, many: int) -> DataFrame:
    """a, b, matched, doc_id, line: of the sets in rows, links to earlier ones and the earliest of these, by list.

    rows: list, i, j (block pair), own (block), a, b, doc_id, line, text.
    """
    dealt = rows.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", F.col("doc_id").asc_nulls_first(), "line", "a", "b")

    def links(table: pa.Table) -> pa.RecordBatch | None:
        """Of whole groups of members, which are in the order of their lines."""
        texts, _ = texts_of(table["text"].combine_chunks())
        number = np.arange(len(texts))
        words = Words([t.replace("\n", " ") for t in texts])
        sets = Sets(words, len(texts), often)
        keys = sets.keys()
        a, b, own = (table[c].to_numpy() for c in ("a", "b", "own"))
        group = np.stack([table[c].to_numpy() for c in ("list", "i", "j")], 1)
        start = np.append(True, (group[1:] != group[:-1]).any(axis=1))
        begin = np.flatnonzero(start)[np.cumsum(start) - 1]
        spot = np.stack([table["doc_id"].is_null().to_numpy(), table["doc_id"].fill_null(0).to_numpy(), table["line"].to_numpy()], 1)
        spot = np.cumsum(start | np.append(True, (spot[1:] != spot[:-1]).any(axis=1)))
        # Rows that repeat a doc_id bring other lines of the same number, and of rows of one key the first counts.
        true = (keys[:, 0] == a) & (keys[:, 1] == b)
        seen = np.lexsort((number, b, a, begin))
        again = np.append(False, (begin[seen[1:]] == begin[seen[:-1]]) & (a[seen[1:]] == a[seen[:-1]]) & (b[seen[1:]] == b[seen[:-1]]) & true[seen[:-1]])
        true[seen[again]] = False
        # The words that name the list, in each set.
        names = words.numbers()[sets.order]
        first, second = listed_words(sets, often, true, many)
        hit = lists_of(sets, first, second) == group[sets.line[second], 0].astype(np.uint32)
        first, second = first[hit], second[hit]
        rows, at = np.unique(sets.line[second], return_index=True)
        true &= np.isin(number, rows)
        one, two = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        one[rows], two[rows] = first[at], second[at]
        name = np.where(true, names[one] * (int(names.max(initial=0)) + 1) + names[two], -1 - number) if len(names) else -1 - number
        cross = group[:, 1] != group[:, 2]
        matched, earliest = np.zeros(len(texts), np.int64), np.full(len(texts), len(texts), np.int64)

        def by_look_up(x: np.ndarray, y: np.ndarray) -> None:
            """Pairs of members (earlier x, later y): each word of y is looked up in x."""
            top = int(names.max()) + 1
            known = np.sort(sets.line * top + names)
            for k, n in chunks(sets.size[y], LOOKED_UP):
                xs, ys = x[k:n], y[k:n]
                size = sets.size[ys]
                pair = np.repeat(np.arange(len(xs)), size)
                place = sets.begin[ys][pair] + np.arange(len(pair)) - (np.cumsum(size) - size)[pair]
                want = xs[pair] * top + names[place]
                found = np.flatnonzero(known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want)
                of, place = pair[found], place[found]
                shared = np.bincount(of, minlength=len(xs))
                rank = np.arange(len(of)) - (np.cumsum(shared) - shared)[of]
                firsts, seconds = np.full(len(xs), -1), np.full(len(xs), -1)
                firsts[of[rank == 0]], seconds[of[rank == 1]] = place[rank == 0], place[rank == 1]
                ok = shared * SIMILAR_DEN >= (sets.size[xs] + size - shared) * SIMILAR_NUM
                ok &= (firsts == one[ys]) & ((one[ys] == two[ys]) | (seconds == two[ys]))
                np.add.at(matched, ys[ok], 1)
                np.minimum.at(earliest, ys[ok], xs[ok])

        def shares(members: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
            """How many of the columns each two members share; row (place among members) and column of each of their words."""
            _, column, n = np.unique(column, return_inverse=True, return_counts=True)
            row, column = row[n[column] > 1], np.unique(column[n[column] > 1], return_inverse=True)[1]
            out = np.zeros((len(members), len(members)), np.float32)
            columns = int(column.max(initial=-1)) + 1
            step = max(1, min(columns, CELLS // len(members)))
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            for low in range(0, columns, step):
                part = slice(*np.searchsorted(column, [low, low + step]))
                grid = np.zeros((len(members), step), np.float32)
                grid[row[part], column[part] - low] = 1
                out += grid @ grid.T
            return out

        def by_matrix(members: np.ndarray) -> None:
            """All pairs of the members of one list, by products of a matrix of members and words."""
            size = sets.size[members]
            row = np.repeat(np.arange(len(members)), size)
            place = sets.begin[members][row] + np.arange(len(row)) - (np.cumsum(size) - size)[row]
            shared = shares(members, row, names[place])
            early = (place < two[members][row]) & (place != one[members][row])
            ok = shares(members, row[early], names[place[early]]) == 0
            ok &= shared * SIMILAR_DEN >= (size[:, None] + size[None, :] - shared) * SIMILAR_NUM
            ok &= spot[members][:, None] < spot[members][None, :]
            if cross[members[0]]:
                ok &= own[members][:, None] != own[members][None, :]
            n = ok.sum(axis=0)
            matched[members] += n
            earliest[members[n > 0]] = members[ok.argmax(axis=0)[n > 0]]

        # Members of one list and of the same words that name it meet.
        order = np.lexsort((number, name, begin))
        order = order[true[order]]
        cut = np.append(np.flatnonzero(np.append(True, (begin[order[1:]] != begin[order[:-1]]) | (name[order[1:]] != name[order[:-1]]))), len(order)) if len(order) else np.zeros(1, np.int64)
        sizes = np.diff(cut)
        for k in np.flatnonzero(sizes >= MANY).tolist():
            by_matrix(order[cut[k] : cut[k + 1]])
        low = np.repeat(cut[:-1], sizes)
        live, back = np.flatnonzero(np.repeat(sizes < MANY, sizes)), 0
        parities, xs, ys = sets.parities(), [], []
        while True:
            back += 1
            live = live[live - back >= low[live]]
            if not len(live):
                break
            x, y = order[live - back], order[live]
            s, t = sets.size[x], sets.size[y]
            ok = (spot[x] != spot[y]) & (np.minimum(s, t) * SIMILAR_DEN >= np.maximum(s, t) * SIMILAR_NUM) & (~cross[y] | (own[x] != own[y]))
            ok &= apart(parities, x, y, s, t, s + t - 2 * least_overlap(s, t))
            xs.append(x[ok])
            ys.append(y[ok])
        if sum(map(len, xs)):
            by_look_up(np.concatenate(xs), np.concatenate(ys))
        y = np.flatnonzero(matched)
        if not len(y):
            return None
        x = pa.array(earliest[y])
        return pa.RecordBatch.from_arrays([pa.array(a[y]), pa.array(b[y]), pa.array(matched[y]), table["doc_id"].combine_chunks().take(x), table["line"].combine_chunks().take(x)], names=["a", "b", "matched", "doc_id", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            sizes = pc.binary_length(batch.column(8)).to_numpy(zero_copy_only=False)
            for i, j in chunks(sizes, VERIFIED):
                held.append(batch.slice(i, j - i))
                table = pa.Table.from_batches(held)
                group = np.stack([table[c].to_numpy() for c in ("list", "i", "j")], 1)
                upto = int(np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))[-1])  # the last group may go on
                if upto and (out := links(table.slice(0, upto))):
                    yield out
                held = table.slice(upto).to_batches()
        if held and (out := links(pa.Table.from_batches(held))):
            yield out

    return dealt.select("list", "i", "j", "own", "a", "b", "doc_id", "line", "text").mapInArrow(run, struct(a="long", b="long", matched="long", doc_id="long", line="int"))


def matches(documents: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """a, b, matched, match: of each set that is similar to earlier ones, their number and the first line of the earliest."""
    with scratch(documents.sparkSession):
        return linked(documents, counting.summed(lines.where("slice is not null").select("slice", "counts"), COUNTERS), firsts)


def linked(documents: DataFrame, often: np.ndarray, firsts: DataFrame) -> DataFrame:
    """matches(), by the number of lines of each counter's words."""
    often = np.minimum(often, (1 << 24) - 1).astype(np.uint32)
    sets = written(listed(documents, often).join(firsts.select("a", "b", "doc_id", "line"), "a"), "listed-sets")
    texts = texts_of_lines(documents, sets.select("doc_id", "line").distinct())
    flag = lambda df: df.withColumns({"no_id": F.col("doc_id").isNull(), "doc": F.coalesce("doc_id", F.lit(0))})  # noqa: E731  joins don't match nulls
    own = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
    # A set of a large list stands in the pairs of blocks (i, j), i <= j, that its block is part of.
    rows = flag(sets).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "b", "doc_id", "line", "doc", "no_id")
    met = rows.join(flag(texts).select("doc", "no_id", "line", "text"), ["doc", "no_id", "line"]).drop("doc", "no_id")
    found = verified(met, often, FREQUENT)
    return written(found.groupBy("a", "b").agg(F.sum("matched").alias("matched"), F.min(F.struct("doc_id", "line")).alias("match")), "line-links", keep=1)


def line_dedup(documents: DataFrame) -> DataFrame:
    """One row per document of documents(doc_id, text, ...): doc_id, class_id, n_links, n_lines, removed.

    Lines end at newlines; words are runs of letters and of digits. Lines come in the order of doc_id, then of their number.
    A line goes if an earlier one has a Jaccard similarity of 0.8 or more, itself removed or not; a line without words stays.
    removed holds the numbers of a document's lines that go (apply() takes them out). n_links is the number of links of its
    lines: a line has one to each distinct set of words that is similar to its own and occurred earlier than that at first,
    and, where it isn't its set's first line, one to that. class_id is the least doc_id that its lines match directly, else
    its own. A null text is empty: one empty line. Rows that repeat a doc_id are one document with the lines of each of them,
    and lines of one number there don't remove each other; null doc_ids likewise, before all others. Other columns are
    ignored; an empty table gives no rows.
    """
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = written(lines_of(documents), "lines")
    lines = table.where("line is not null").select("doc_id", "line", "a", "b")
    firsts = lines.where("a is not null").groupBy("a", "b").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("n"))
    firsts = written(firsts.select("a", "b", "at.doc_id", "at.line", "n"), "first-lines")
    links = matches(documents, table, firsts)
    in_all = firsts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("a").isin([r["a"] for r in firsts.where(F.col("n") > in_all / SHARE).where(F.col("n") > SALTS).select("a").collect()])
    salt = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    dealt = F.xxhash64("doc_id", "line")
    told = firsts.join(links, ["a", "b"], "left").where("match is not null or n > 1").select("a", "b", F.struct("doc_id", "line").alias("first"), "match", "matched", salt)
    rows = lines.withColumn("salt", F.when(F.col("a").isNull(), F.pmod(dealt, F.lit(1 << 30))).when(hot, F.pmod(dealt, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).join(told, ["a", "b", "salt"], "left")
    own = F.struct("doc_id", "line")
    source = F.when(F.col("match").isNotNull(), F.least("match", "first")).when(F.col("first").isNotNull() & ~own.eqNullSafe(F.col("first")), F.col("first"))
    copied = (F.col("first").isNotNull() & ~own.eqNullSafe(F.col("first"))).cast("long")
    rows = rows.select("doc_id", "line", source["doc_id"].alias("source"), source.isNotNull().alias("gone"), (F.coalesce("matched", F.lit(0)) + copied).alias("links"))
    grouped = rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("links").alias("n_links"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"))
    return grouped.select("doc_id", F.coalesce(F.least("source", "doc_id"), "doc_id").alias("class_id"), "n_links", "n_lines", "removed")


def apply(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """documents without the lines that line_dedup() removes."""
    gone = removed.select("doc_id", "removed")
    kept = F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), k))
    return documents.join(gone, "doc_id", "left").withColumn("text", F.array_join(kept, "\n")).select(*documents.columns)
