"""Words, lines and word n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once. Arrays of eight bytes for each of them are held, several at a time.
CHUNK = 1 << 21

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = U(pow(_BASE, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_TURNS = mix(np.arange(300, 364, dtype=np.uint64) * U(_BASE)) | U(1)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2^64; kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        length = max(n, CHUNK + 1)
        _powers[:] = [
            np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(length - 1, b, dtype=np.uint64))])
            for b in (U(_BASE), _INVERSE)
        ]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to before its end; equal bytes have equal hashes."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _TURNS[63])


class Texts:
    """Some texts: ``data`` (their bytes), ``offsets`` (of each text in data), and their words on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.offsets = offsets.astype(np.int64)
        self.raw = data
        self.data = _LOWER[data] if lower else data
        self.n = len(offsets) - 1
        inside = ~_SPACE[data]
        self.inside = inside
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        before[self.offsets] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def words(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)


def texts(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, Texts]]:
    """The texts of a string column in runs of about ``CHUNK`` bytes: the place of the first, and the run.

    Null is an empty text. A text longer than ``CHUNK`` is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    content = column.buffers()[2]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        end = min(end, len(column))
        yield row, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower)
        row = end


def word_grams(t: Texts, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside a text, the text of each, and the place of its first word.

    With ``whole``, a text of fewer words, but at least one, has one gram: all its words.
    """
    hashes, text = t.words(), t.text_of_words()
    place = np.arange(len(hashes)) - t.first[:-1][text]
    left = t.counts[text] - place
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(size):
        part = np.zeros(len(hashes), dtype=np.uint64)
        part[: max(len(hashes) - k, 0)] = hashes[k:] * _TURNS[k]
        total += np.where(left > k, part, U(0))
    valid = (left >= size) | ((place == 0) if whole else False)
    at = np.flatnonzero(valid)
    return mix(total[at] + np.minimum(t.counts[text[at]], size).astype(np.uint64)), text[at], at


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, sorted inside it, and the text of each."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]
