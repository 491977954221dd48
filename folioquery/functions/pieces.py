"""Vocabulary models: their files, the normalising of texts by a character map, and ids as an embedding model expects them.

A file is a sequence of fields: a number and a wire type, then a varint, four or eight bytes, or as many bytes as a length
says. A character map holds replacements by longest match, as a double array over UTF-8 bytes and a pool of replacements.
Matches are looked for at all characters of many texts at once, by array operations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from folioquery.functions.embedding import Pieces

# ---- fixed values: numbers of the format ----
VARINT, FIXED64, SIZED, FIXED32 = 0, 1, 2, 5
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
TRAINER_KIND = 3
NORMALIZER_MAP, NORMALIZER_PREFIX, NORMALIZER_SQUEEZE, NORMALIZER_ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL = 1, 2, 3
UNIGRAM = 1
#: How an embedding model numbers what isn't a piece, by how much it shifts pieces, and its longest input.
FIRST, LAST, UNKNOWN_ID, SHIFT, LONGEST = 0, 2, 3, 1, 512
BLANK = "▁"


class DamagedModel(ValueError):
    """A file that can't be a model, or ends too early."""


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field: a number for a varint, else bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= end or shift > 63:
                raise DamagedModel(f"a number at byte {at} doesn't end")
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if number == 0 or kind not in (VARINT, FIXED64, SIZED, FIXED32):
            raise DamagedModel(f"no field {number} of wire type {kind} can stand before byte {at}")
        if kind == VARINT:
            yield number, kind, varint()
            continue
        size = varint() if kind == SIZED else 8 if kind == FIXED64 else 4
        if size > end - at:
            raise DamagedModel(f"field {number} goes beyond the end by {size - end + at} bytes")
        at += size
        yield number, kind, data[at - size : at]


def encoded(number: int, value: int | float | bytes) -> bytes:
    """A field: ints as varints, floats in four bytes, bytes with their length."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    kind = FIXED32 if isinstance(value, float) else VARINT if isinstance(value, int) else SIZED
    tag = varint(number << 3 | kind)
    return tag + (struct.pack("<f", value) if kind == FIXED32 else varint(int(value)) if kind == VARINT else varint(len(value)) + value)


@dataclass(frozen=True)
class Model:
    """pieces: (text, score, kind) by id; charsmap: the character map as it stands in the file."""

    pieces: list[tuple[str, float, int]]
    charsmap: bytes = b""
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    kind: int = UNIGRAM

    @classmethod
    def parse(cls, data: bytes) -> Model:
        """A model from a file's bytes; fields that aren't needed are skipped, damaged files raise DamagedModel."""
        pieces: list[tuple[str, float, int]] = []
        rest: dict = {}
        for number, wire, value in fields(data):
            if number in (PIECE, TRAINER, NORMALIZER) and wire != SIZED:
                raise DamagedModel(f"field {number} has to be a message")
            if number == PIECE:
                own: dict = {n: v for n, _, v in fields(value)}
                score = own.get(PIECE_SCORE, b"\0\0\0\0")
                if not isinstance(score, bytes) or len(score) != 4 or not isinstance(own.get(PIECE_TEXT, b""), bytes):
                    raise DamagedModel(f"piece {len(pieces)} is of other types")
                try:
                    text = own.get(PIECE_TEXT, b"").decode("utf-8")
                except UnicodeDecodeError as e:
                    raise DamagedModel(f"piece {len(pieces)} isn't UTF-8") from e
                pieces.append((text, struct.unpack("<f", score)[0], own.get(PIECE_KIND, NORMAL)))
            elif number == TRAINER:
                rest |= {"kind": v for n, _, v in fields(value) if n == TRAINER_KIND}
            elif number == NORMALIZER:
                names = {NORMALIZER_MAP: "charsmap", NORMALIZER_PREFIX: "prefix", NORMALIZER_SQUEEZE: "squeeze", NORMALIZER_ESCAPE: "escape"}
                rest |= {names[n]: v if n == NORMALIZER_MAP else bool(v) for n, _, v in fields(value) if n in names}
        return cls(pieces, **rest)

    def file(self) -> bytes:
        """The file that parse() reads."""
        parts = [encoded(PIECE, encoded(PIECE_TEXT, t.encode()) + encoded(PIECE_SCORE, float(s)) + encoded(PIECE_KIND, k)) for t, s, k in self.pieces]
        normalizer = encoded(NORMALIZER_MAP, self.charsmap) + encoded(NORMALIZER_PREFIX, int(self.prefix)) + encoded(NORMALIZER_SQUEEZE, int(self.squeeze)) + encoded(NORMALIZER_ESCAPE, int(self.escape))
        return b"".join([*parts, encoded(TRAINER, encoded(TRAINER_KIND, self.kind)), encoded(NORMALIZER, normalizer)])


# ---- the character map ----

def charsmap(replacements: dict[str, str]) -> bytes:
    """A character map of replacements, in the form that files have: the trie's size, its units, the pool."""
    pool, at = bytearray(), {}
    for text in sorted(set(replacements.values())):
        at[text] = len(pool)
        pool += text.encode() + b"\0"
    root: dict = {}
    for source, target in replacements.items():
        if not source or "\0" in source or "\0" in target:
            raise ValueError("a replacement needs a source, and neither may hold a zero")
        node = root
        for byte in source.encode():
            node = node.setdefault(byte, {})
        node[None] = at[target]
    units: dict[int, int] = {}
    taken, bases = {0}, set()
    lowest = 1

    def place(labels: list[int]) -> int:
        """The first base at which there is room for the labels."""
        nonlocal lowest
        while lowest in taken:
            lowest += 1
        base = lowest
        while base in bases or any(base ^ k in taken for k in labels):
            base += 1
        bases.add(base)
        taken.update(base ^ k for k in labels)
        return base

    waiting = [(0, 0, root)]  # where a node stands, its label, the node
    while waiting:
        index, label, node = waiting.pop()
        base = place([0 if k is None else k for k in node])
        offset = index ^ base
        if offset >= 1 << 21:
            raise ValueError("too many replacements for this builder")
        units[index] = offset << 10 | (None in node) << 8 | label
        for k, child in node.items():
            if k is None:
                units[base] = 1 << 31 | child
            else:
                waiting.append((base ^ k, k, child))
    size = (max(units) | 0xFF) + 1
    array = np.full(size, 1 << 31, np.uint32)  # no label
    for index, unit in units.items():
        array[index] = unit
    return struct.pack("<I", 4 * size) + array.astype("<u4").tobytes() + bytes(pool)


def joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that start at starts and have sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Normaliser:
    """Replaces by the character map, and treats blanks as the model's file says."""

    charsmap: bytes
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    units: np.ndarray = field(init=False)
    pool: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = struct.unpack("<I", self.charsmap[:4])[0] if len(self.charsmap) >= 4 else 0
        if size % 4 or 4 + size > max(4, len(self.charsmap)):
            raise DamagedModel("the character map ends too early")
        self.units = np.frombuffer(self.charsmap[4 : 4 + size], "<u4").astype(np.int64)
        self.pool = np.frombuffer(self.charsmap[4 + size :], np.uint8)
        zeros = np.flatnonzero(self.pool == 0)
        # Where the replacement that starts at a place of the pool ends.
        self.ends = zeros[np.minimum(np.searchsorted(zeros, np.arange(len(self.pool))), len(zeros) - 1)] if len(zeros) else np.zeros(0, np.int64)

    @staticmethod
    def offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def matches(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the longest source at each of starts, 0 if none; where its replacement stands in the pool)"""
        size, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return size, value
        live, node = np.arange(len(starts)), np.full(len(starts), self.offset(self.units[:1])[0])
        step = 0
        while len(live):
            inside = starts[live] + step < len(data)
            live, node = live[inside], node[inside]
            byte = data[starts[live] + step].astype(np.int64)
            node = node ^ byte
            known = node < len(self.units)
            live, node, byte = live[known], node[known], byte[known]
            unit = self.units[node]
            own = (unit & (1 << 31 | 0xFF)) == byte
            live, node, unit = live[own], node[own], unit[own]
            node = node ^ self.offset(unit)
            leaf = (unit >> 8 & 1 == 1) & (node < len(self.units))
            size[live[leaf]] = step + 1
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
            step += 1
        return size, value

    def replaced(self, texts: list[str]) -> list[list[bytes]]:
        """Each text as a list of runs: replacements by themselves, and what stands between them."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)  # no source holds a zero
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        size, value = self.matches(data, starts)
        edges = np.cumsum([len(r) + 1 for r in raw])
        out: list[list[bytes]] = [[] for _ in texts]
        whole, pool = data.tobytes(), self.pool.tobytes()
        done, text = 0, 0
        for k in np.flatnonzero(size):
            at = int(starts[k])
            if at < done:
                continue  # within the last match
            while at >= edges[text]:
                out[text].append(whole[done : edges[text] - 1])
                done, text = int(edges[text]), text + 1
            out[text] += [whole[done:at], pool[value[k] : self.ends[value[k]]]]
            done = at + int(size[k])
        while text < len(texts):
            out[text].append(whole[done : edges[text] - 1])
            done, text = int(edges[text]), text + 1
        return out

    def texts(self, texts: list[str]) -> list[str]:
        return [self.blanks(runs) for runs in self.replaced(texts)]

    def blanks(self, runs: list[bytes]) -> str:
        """Runs as one text, its blanks as the file says: leading, trailing and doubled ones go, one more stands before the text, and each is written as BLANK.

        Blanks double where a run begins with one and what was written ends with one; within a replacement they stay.
        """
        mark = (BLANK if self.escape else " ").encode()
        if not self.squeeze:
            body = b"".join(runs)
            return ((b" " if self.prefix else b"") + body).replace(b" ", mark).decode("utf-8", "replace") if body or len(runs) > 1 else ""
        out, before = bytearray(), True
        for k, run in enumerate(runs):
            if k % 2 == 0:  # the text's own letters: each is a run by itself
                while b"  " in run:
                    run = run.replace(b"  ", b" ")
            own = run.lstrip(b" ") if before else run
            if own:
                out += own
                before = own.endswith(b" ")
        if not out:
            return ""
        whole = ((b" " if self.prefix else b"") + bytes(out)).replace(b" ", mark)
        while whole.endswith(mark):
            whole = whole[: -len(mark)]
        return whole.decode("utf-8", "replace")


# ---- ids ----

class Encoder:
    """Texts to ids through a unigram model: its normaliser, the likeliest pieces, and the numbers that an embedding model expects."""

    #: Words whose ids are remembered.
    KNOWN = 200_000

    def __init__(self, model: Model):
        if model.kind != UNIGRAM:
            raise ValueError("pieces of a unigram model are asked for")
        self.normaliser = Normaliser(model.charsmap, model.prefix, model.squeeze, model.escape)
        unknown = max((k for k, (*_, kind) in enumerate(model.pieces) if kind == UNKNOWN), default=0)
        usable = {t: (s, k) for k, (t, s, kind) in enumerate(model.pieces) if kind not in (UNKNOWN, CONTROL) and t}
        self.pieces = Pieces(usable, unknown)
        #: Where blanks only begin pieces, words are cut at them without loss, and each distinct word is cut once.
        self.by_word = bool(usable) and not any(BLANK in t[1:] for t in usable)
        self.known: dict[str, list[int]] = {}

    def of_word(self, word: str) -> list[int]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            found = self.known[word] = self.pieces.segment(word)
        return found

    def pieces_of(self, normalised: str) -> list[int]:
        """Ids of pieces; a run of unknown ones is one."""
        if not self.pieces.scores:
            return [self.pieces.unknown] if normalised else []
        if not self.by_word:
            return self.pieces.segment(normalised)
        first, *words = normalised.split(BLANK)
        ids = list(self.of_word(first)) if first else []
        for word in words:
            own = self.of_word(BLANK + word)
            same = ids and own and ids[-1] == own[0] == self.pieces.unknown
            ids += own[1:] if same else own
        return ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, as numbered by the embedding model."""
        unknown = self.pieces.unknown
        return [[UNKNOWN_ID if k == unknown else k + SHIFT for k in self.pieces_of(t)] for t in self.normaliser.texts(texts)]

    @staticmethod
    def framed(ids: Iterable[int], longest: int = LONGEST) -> list[int]:
        """ids between the marks of beginning and end, cut to the model's longest input."""
        return [FIRST, *list(ids)[: longest - 2], LAST]
