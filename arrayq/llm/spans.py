"""Words, lines and their 64-bit hashes over Arrow text columns, vectorised.

A batch of texts stays one byte buffer.  Words are the runs of bytes other than
``[\\x20\\x09-\\x0D]``; a word's hash is a polynomial over its bytes modulo
2**64, got from one running sum for the whole buffer, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes of text that are hashed together; longer single texts go alone.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Texts:
    """Some texts as one byte buffer; text ``i`` is ``data[at[i]:at[i + 1]]``."""

    data: np.ndarray
    at: np.ndarray
    first: int = 0

    def __len__(self) -> int:
        return len(self.at) - 1

    def lowered(self) -> Texts:
        """With A-Z as a-z."""
        return Texts(_LOWER[self.data], self.at, self.first)

    def words(self, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words (runs of bytes not ``outside``), and for each text where its words begin (one more at the end)."""
        inside = ~outside[self.data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = self.at[:-1][self.at[:-1] < len(inside)]
            before[cuts] = False
            cuts = self.at[1:][self.at[1:] > 0] - 1
            after[cuts] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        up, down = _grown(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * up[: len(self.data)], out=total[1:], dtype=np.uint64)
        raw = (total[ends] - total[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def prefix_hashes(self, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """For each size the hashes of the ranges' first bytes; a shorter range counts as padded, so it differs from the range itself."""
        up, down = _grown(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * up[: len(self.data)], out=total[1:], dtype=np.uint64)
        begun, back = total[starts], down[starts]
        return [mix((total[np.minimum(starts + n, ends)] - begun) * back + np.uint64(n << 32)) for n in sizes]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column (null: empty) in runs of about ``most`` bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def windows(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes (runs may span texts; the caller leaves those out)."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hashes[:n].copy()
    for j in range(1, size):
        out = mix(out * _BASE + word_hashes[j : j + n])
    return out


def sequences(word_hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the word runs ``first[i]:last[i]``, each of any length, from one running sum."""
    up, down = _grown(len(word_hashes) + 1)
    total = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * up[: len(word_hashes)], out=total[1:], dtype=np.uint64)
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def shingles(word_hashes: np.ndarray, words_at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending.

    A text with fewer words than ``size`` has its whole sequence as its only
    shingle; one without words has none.
    """
    rolled = windows(word_hashes, size)
    for i in range(len(words_at) - 1):
        a, b = int(words_at[i]), int(words_at[i + 1])
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own
        elif b > a:
            yield mix(windows(word_hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
