"""Word and shingle hashes of whole text columns, without a Python step per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

# Word separators of every operator here: space, and tab to carriage return.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
# Bytes hashed at once, and the length from which one word is hashed on its own.
_BLOCK = 1 << 20
_LONG_WORD = 1 << 16



class _Made(dict):
    """Tables a worker keeps; they never travel with a function that uses them."""

    def __reduce__(self):
        return _Made, ()


_powers = _Made()


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, made once per worker."""
    if not _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(_BLOCK + _LONG_WORD + 1, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        _powers[0], _powers[1] = tables
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed finalizer)."""
    h = h.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Where the words of a text column lie; `first[d]:first[d + 1]` are those of row d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        inside = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, head: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `head` bytes."""
        ends = self.ends if head is None else np.minimum(self.ends, self.starts + head)
        out = np.empty(len(self), dtype=np.uint64)
        power, inverse = _power_tables()
        i = 0
        while i < len(out):
            j = int(np.searchsorted(self.starts, self.starts[i] + _BLOCK))
            low = int(self.starts[i])
            s, e = self.starts[i:j] - low, ends[i:j] - low
            long = np.flatnonzero(e - s > _LONG_WORD)
            e = np.minimum(e, s + _LONG_WORD)
            span = self.data[low : low + int(e.max())]
            sums = np.zeros(len(span) + 1, dtype=np.uint64)
            np.cumsum((span.astype(np.uint64) + np.uint64(1)) * power[: len(span)], out=sums[1:])
            h = (sums[e] - sums[s]) * inverse[s]
            out[i:j] = mixed(h + (e - s).astype(np.uint64) * np.uint64(_BASE))
            for w in long + i:
                whole = self.data[self.starts[w] : ends[w]].tobytes()
                digest = hashlib.blake2b(whole, digest_size=8).digest()
                out[w] = int.from_bytes(digest, "little")
            i = j
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `width` words in a row, and the bounds of each row's shingles.

    A text of fewer words is one shingle as a whole; a text without words has none.
    """
    factor = np.uint64(0x9FB21C651E98DF25)
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    # One rolling value per word, also across rows; only those inside a row are taken.
    rolling = np.full(max(0, len(hashes) - width + 1), width, dtype=np.uint64)
    for k in range(width):
        rolling *= factor
        rolling += hashes[k : k + len(rolling)]
    out = np.zeros(bounds[-1], dtype=np.uint64)
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], made)
    full = np.repeat(count >= width, made)
    out[full] = rolling[at[full]]
    for row in np.flatnonzero((count > 0) & (count < width)):
        value = int(count[row])
        for h in hashes[first[row] : first[row + 1]].tolist():
            value = (value * int(factor) + h) % (1 << 64)
        out[bounds[row]] = value
    return mixed(out), bounds


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """Per row, the ascending distinct hashes of its lower-cased word shingles."""
    data, offsets = flat(column)
    words = Words(data, offsets)
    found, bounds = shingles(words.hashes(), words.first, width)
    return [distinct(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
