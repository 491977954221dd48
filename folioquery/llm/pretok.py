"""Vectorised splitting of texts into pre-tokens, and encoding through a table of distinct words.

The split is that of public_tokenizers.PATTERN. It is found with array operations over the code points of many texts at
once; pyarrow then hashes the words, so that a tokenizer only sees each distinct word once in a while.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat, zip_longest

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, EDGE = 1, 2, 3, 0, 4
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Distinct words whose ids a Python worker remembers, and of them those of the tokenizers library, which have few ids each.
KNOWN_WORDS, LIBRARY_WORDS = 300_000, 450_000
#: Words that go to a tokenizer in one text.
JOINED = 1000
#: A byte that UTF-8 has not.
NO_BYTE = 0xFF


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    whole = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, whole):
            out[points[m.start() : m.end()]] = kind
    return out


def starts_of_words(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. points: code points of texts, an extra one at each of edges after each text."""
    n = len(points)
    kind = classes()[points]
    kind[edges] = EDGE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, kind[:-1]
    start = kind != before
    blank = points == 0x20
    blank[edges] = False
    # The last white space before a word: a blank joins that word, another character stands alone.
    last = kind == SPACE
    last[:-1] &= (kind[1:] != SPACE) & (kind[1:] != EDGE)
    last[-1] = False
    start |= last
    joined = np.flatnonzero(last & blank) + 1
    start[joined] = False
    # Contractions start where a lone apostrophe starts a word.
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[kind[at + 1] == LETTER]
    if len(at):
        one = points[at + 1]
        two = points[np.minimum(at + 2, n - 1)]
        inside = kind[np.minimum(at + 2, n - 1)] == LETTER
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            double |= inside & (one == ord(a)) & (two == ord(b))
        for hit, size in ((single, 2), (double & ~single, 3)):
            p = at[hit]
            start[p + 1] = False
            end = p + size
            end = end[end < n]
            start[end] = True
    return start


@lru_cache(1)
def lower_points() -> np.ndarray:
    """The lower case of each code point, where it is one, in 64 bits."""
    out = np.arange(0x110000, dtype=np.uint64)
    for c in range(0x20000):
        if len(x := chr(c).lower()) == 1:
            out[c] = ord(x)
    return out


@lru_cache(1)
def word_classes() -> np.ndarray:
    """The class of each code point that is a letter or a digit, else 0."""
    kind = classes()
    return np.where((kind == LETTER) | (kind == NUMBER), kind, 0).astype(np.uint8)


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


class Words:
    """The words of texts - runs of letters, runs of digits, in lower case - by array operations.

    n_lines: lines of each text; line: each word's line, counted over all texts; hashes: 64 bits of each word; points, start,
    end: the lower-case code points of the texts, and where each word stands in them.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        coded = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        raw = coded.astype(np.intp)
        kind = np.zeros(len(raw) + 2, np.uint8)
        word_classes().take(raw, out=kind[1:-1], mode="clip")
        edge = kind[1:] != kind[:-1]
        self.start, self.end = np.flatnonzero(edge & (kind[1:] > 0)), np.flatnonzero(edge & (kind[:-1] > 0))
        up, down = powers(1 << max(12, int(len(raw)).bit_length()))
        self.points = lower_points().take(raw, mode="clip")
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.points * up[: len(raw)], out=total[1:])
        mixed = (total.take(self.end) - total.take(self.start)) * down.take(self.start)
        self.hashes = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        breaks = np.flatnonzero(coded == 10)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n_lines = np.diff(np.append(-1, np.searchsorted(breaks, np.cumsum(lengths + 1) - 1)))
        self.line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(self.start, breaks), prepend=0))

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for equal words and for no others: words of one hash are compared by their letters."""
        _, first, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        of = first[number]
        size = self.end - self.start
        same = size == size[of]
        at = np.flatnonzero(same)
        ends = np.cumsum(size[at])
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size[at], size[at])
        differ = self.points[np.repeat(self.start[at], size[at]) + step] != self.points[np.repeat(self.start[of[at]], size[at]) + step]
        same[np.repeat(at, size[at])[differ]] = False
        if not same.all():  # different words of one hash
            names: dict[tuple, int] = {}
            for k in np.flatnonzero(~same):
                number[k] = len(first) + names.setdefault((int(number[k]), self.points[self.start[k] : self.end[k]].tobytes()), len(names))
        return number


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, line of each word, 32-bit hash of each word)"""
    words = Words(texts)
    return words.n_lines, words.line, (words.hashes >> np.uint64(32)).astype(np.uint32)


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of texts as a binary array, and how many each text has."""
    if not texts:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    joined = "\n".join(texts) + "\n"
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.cumsum(lengths + 1) - 1
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    data = joined.encode("utf-8")
    start = starts_of_words(points, edges)
    start[edges] = True
    where = np.flatnonzero(start)
    if len(data) == len(points):
        offsets = where
    else:
        width = np.ones(len(points), np.int8)
        width += points > 0x7F
        width += points > 0x7FF
        width += points > 0xFFFF
        byte = np.cumsum(width, dtype=np.int64)
        offsets = byte[where] - width[where]
    bounds = np.append(offsets, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(where), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    edge = np.searchsorted(where, edges)  # the words that are the extra characters
    real = np.ones(len(where), bool)
    real[edge] = False
    counts = np.diff(np.append(-1, edge)) - 1
    return words.filter(pa.array(real)), counts


def listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """Words of UTF-8, none of them empty, as a list: cut at a byte that UTF-8 has not, which is far quicker than to_pylist()."""
    if not len(words):
        return []
    bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return np.insert(data, bounds[1:-1] - bounds[0], NO_BYTE).tobytes().split(bytes([NO_BYTE]))


class WordTable:
    """Ids of distinct words, filled by encode_new(list of words as bytes) -> (counts, flat ids).

    Beyond most words, the half that was met in the most runs of texts stays.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = KNOWN_WORDS):
        self.encode_new, self.most = encode_new, most
        self.number: dict[bytes, int] = {}
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.int32)

    def add(self, new: list[bytes]) -> None:
        counts, flat = self.encode_new(new)
        base = len(self.number)
        self.number.update(zip(new, range(base, base + len(new))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])

    def thin(self) -> None:
        stays = np.sort(np.argsort(self.met, kind="stable")[len(self.met) - self.most // 2 :])
        size = np.diff(self.start)
        held = np.zeros(len(size), bool)
        held[stays] = True
        self.ids = self.ids[np.repeat(held, size)]
        self.start = np.append(0, np.cumsum(size[stays]))
        self.met = self.met[stays] // 2  # what was met long ago counts less and less
        names = list(self.number)  # in the order of their numbers
        self.number = {names[k]: n for n, k in enumerate(stays.tolist())}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, number of ids of each text)"""
        words, per_text = split_words(texts)
        if len(words) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        distinct = listed(coded.dictionary)
        if len(self.number) > self.most:
            self.thin()
        places = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = len(self.number) + np.arange(len(new))
            self.add([distinct[k] for k in new.tolist()])
        self.met[places] += 1
        first, size = self.start[places], self.start[places + 1] - self.start[places]
        word = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[word]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(first[word] - (ends - sizes), sizes) + np.arange(ends[-1])]
        at = np.append(0, ends)[np.append(0, np.cumsum(per_text))]
        return flat, np.diff(at)


def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about most bytes together; one row at least."""
    total = np.cumsum(sizes)
    i, n = 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


_tables: dict[tuple[str, str], object] = {}


def byte_names() -> np.ndarray:
    """The character by which a byte-level vocabulary names each byte; a line feed for NO_BYTE."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.arange(256, dtype="<u4")
    others = np.setdiff1d(out, own)
    out[others] = 256 + np.arange(len(others))
    out[NO_BYTE] = ord("\n")
    return out


def library_encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """texts -> (flat ids, counts) as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them.

    The tokenizers library encodes each distinct word; a text holding the string of a special token goes to it whole.
    """
    if (found := _tables.get(("library", path))) is not None:
        return found
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]

    width = np.zeros(tok.get_vocab_size(with_added_tokens=True), np.int64)  # bytes of each token; a character of its name is a byte
    for name, k in tok.get_vocab(with_added_tokens=False).items():
        width[k] = len(name)

    # The same tokenizer for words that are split and whose bytes are named already, a line each: it need not search them for words again.
    split = tok.pre_tokenizer
    in_lines = tok.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
    lines = Tokenizer.from_file(path)
    lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    names = byte_names()

    def one_by_one(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))

    def encode_new(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many words go to the library in one text; their ids are told apart by their bytes."""
        runs = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        texts = [names[np.frombuffer(bytes([NO_BYTE]).join(run), np.uint8)].tobytes().decode("utf-32-le") for run in runs] if in_lines else []
        parts = []
        for run, got in zip_longest(runs, lines.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids if got else [], np.uint32)
            ends, upto = np.cumsum(np.fromiter(map(len, run), np.int64, len(run))), np.cumsum(width[ids])
            at = np.searchsorted(upto, ends)
            if len(ids) and upto[-1] == ends[-1] and (upto[at] == ends).all():
                parts.append((np.diff(at, prepend=-1), ids))
            else:
                parts.append(one_by_one(run))  # the library splits it otherwise
        counts, flat = zip(*parts)
        return np.concatenate(counts), np.concatenate(flat)

    words = WordTable(encode_new, LIBRARY_WORDS)

    def encode(texts: list[str]):
        odd = [k for k, t in enumerate(texts) if any(s in t for s in special)]
        if not odd:
            return words.encode(texts)
        plain = list(texts)
        for k in odd:
            plain[k] = ""
        flat, counts = words.encode(plain)
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for k in odd:
            parts[k] = np.array(tok.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    _tables[("library", path)] = encode
    return encode


def texts_of(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Texts with null as empty, and their sizes in bytes."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())  # bytes become a list far quicker than strings
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return [t.decode() if t else "" for k in range(0, len(column), 256) for t in column.slice(k, 256).to_pylist()], sizes
