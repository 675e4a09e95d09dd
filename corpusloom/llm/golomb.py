"""Golomb-Rice coding of sorted hashes, whole lists at a time."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<QB"
# Values whose remainders are packed at once: bounds the memory of one step.
_STEP = 1 << 16


def encode(values: np.ndarray) -> bytes:
    """Code ascending unsigned values: gaps as unary quotients and k-bit remainders.

    k follows the mean gap, so that a hash costs about two bits more than its
    information. Unary and remainder bits lie apart, each packed as one run.
    An empty list gives a bare head; repeated values are gaps of zero.
    """
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return struct.pack(_HEAD, 0, 0)
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(values[-1] // np.uint64(n)).bit_length() - 1)
    ones = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    unary[ones] = 1
    parts = [struct.pack(_HEAD, n, k), np.packbits(unary).tobytes()]
    if k:
        # A step is a multiple of eight values, so its bits end on a whole byte.
        parts += [_low_bits(gaps[i : i + _STEP], k) for i in range(0, n, _STEP)]
    return b"".join(parts)


def _low_bits(values: np.ndarray, k: int) -> bytes:
    octets = values.astype("<u8").view(np.uint8).reshape(len(values), 8)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :k]).tobytes()


def decode(blob: bytes) -> np.ndarray:
    """The values that `encode` was given."""
    n, k = struct.unpack_from(_HEAD, blob)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    body = np.frombuffer(blob, dtype=np.uint8, offset=struct.calcsize(_HEAD))
    tail = -(-n * k // 8)
    unary = np.unpackbits(body[: len(body) - tail])
    ones = np.flatnonzero(unary)[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        packed = body[len(body) - tail :]
        for i in range(0, n, _STEP):
            m = min(_STEP, n - i)
            bits = np.unpackbits(packed[i * k // 8 : -(-(i + m) * k // 8)])[: m * k].reshape(m, k)
            wide = np.zeros((m, 64), dtype=np.uint8)
            wide[:, :k] = bits
            gaps[i : i + m] |= np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64)
