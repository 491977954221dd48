"""What an embedding model needs around it: prefixes, pieces of words, mean pooling, unit length."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

# What texts are marked with; how much less likely than the unlikeliest piece an unknown letter is.
PASSAGE, QUERY, UNKNOWN_PENALTY = "passage: ", "query: ", 10.0


def passage(text: Column) -> Column:
    return F.concat(F.lit(PASSAGE), text)


def question(text: Column) -> Column:
    return F.concat(F.lit(QUERY), text)


def unit(vector: Column) -> Column:
    """vector at length one; one without length is null."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm))


def pooled(tokens: Column) -> Column:
    """The mean of token vectors (an array of arrays of one size), at length one."""
    first = F.transform(tokens[0], lambda x: x.cast("double"))
    total = F.aggregate(F.slice(tokens, 2, F.greatest(F.lit(1), F.size(tokens))), first, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return unit(F.transform(total, lambda x: x / F.size(tokens)))


@dataclass(frozen=True)
class Pieces:
    """A unigram vocabulary: the score (log probability) and id of each piece."""

    scores: dict[str, tuple[float, int]]
    unknown: int

    @cached_property
    def bounds(self) -> tuple[float, int]:
        """The score of an unknown letter, and the length of the longest piece: made once for a vocabulary, not for each word."""
        return min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY, max(map(len, self.scores))

    def segment(self, text: str) -> list[int]:
        """Ids of the likeliest segmentation. An unknown letter scores UNKNOWN_PENALTY under the least piece; a run of such is one id.

        Of segmentations of equal score the one whose last piece starts first counts, at each place.
        """
        least, longest = self.bounds
        paths: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # score, start and id of the best last piece
        for end in range(1, len(text) + 1):
            ways = [(paths[start][0] + s, start, k) for start in range(max(0, end - longest), end) for s, k in [self.scores.get(text[start:end], (None, -1))] if s is not None]
            if text[end - 1] not in self.scores:
                ways.append((paths[end - 1][0] + least, end - 1, self.unknown))
            paths.append(max(ways, key=lambda w: (w[0], -w[1])))
        out: list[int] = []
        end = len(text)
        while end:
            _, start, k = paths[end]
            if k != self.unknown or not out or out[-1] != self.unknown:
                out.append(k)
            end = start
        return out[::-1]
