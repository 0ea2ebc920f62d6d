"""Words of many texts at once, as 64-bit identifiers in arrays.

Texts are lower-cased by Spark. A word is a run of ASCII letters, digits and bytes of wider
characters; its identifier is a polynomial of its bytes, so equal words have equal identifiers
everywhere. Identifiers of word runs are built from those of the words.
"""

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  # bytes handled at a time
IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
NEWLINE = 10
MULTIPLIER = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full(255, MULTIPLIER, np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and identifier of every word of one stretch of lower-cased UTF-8."""
    inside = IS_WORD[data]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.zeros(len(data), np.int64)
    place[starts[0]:] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    # Beyond 255 bytes the powers repeat, from a mixed multiple of the place.
    power = POWERS[place & 255] + (place >> 8).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    value = np.where(inside, BYTE_VALUES[data] * power, np.uint64(0))
    return starts, mix(np.add.reduceat(value, starts))


def runs(ids: np.ndarray, width: int) -> np.ndarray:
    """Identifier of every run of ``width`` words."""
    n = max(0, len(ids) - width + 1)
    found = np.zeros(n, np.uint64)
    for k in range(width):
        found = found * np.uint64(MULTIPLIER) + ids[k : k + n]
    return mix(found)


INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class RunningHash:
    """Identifiers of runs of any width from one pass over the words: a run's polynomial is the
    difference of two prefix sums, moved to the first place."""

    def __init__(self, ids: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * _powers(MULTIPLIER, len(ids)), dtype=np.uint64)])
        self.back = _powers(INVERSE, len(ids) + 1)

    def runs(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.back[:n])


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive texts that together have at most ``limit`` bytes; a longer
    text comes alone."""
    k = 0
    while k < len(offsets) - 1:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1)
        yield k, end
        k = end


def text_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, number of the text of every word, identifier of every word), for blocks of
    texts ``data[offsets[i]:offsets[i + 1]]``. No word crosses from one text to the next."""
    for first, end in blocks(offsets):
        lo, hi = int(offsets[first]), int(offsets[end])
        inner = offsets[first + 1 : end] - lo
        stretch = np.insert(data[lo:hi], inner, NEWLINE)  # a separator between texts
        starts, ids = word_ids(stretch)
        bounds = inner + np.arange(1, len(inner) + 1)
        yield first, first + np.searchsorted(bounds, starts, "right"), ids
