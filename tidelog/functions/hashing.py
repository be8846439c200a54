"""Exact 32- and 64-bit hashes, vectorised over many byte strings at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Offset and multipliers of the two key hashes of the Bloom filter.
OFFSET = 14695981039346656037
PRIME = 1099511628211
SECOND_START = 1099511628211
SECOND_PRIME = 1000000007

#: Reflected form of the Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def joined(keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the bytes of all strings, where each starts, their lengths)."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    return np.frombuffer(b"".join(keys), np.uint8), np.cumsum(lengths) - lengths, lengths


def _by_length(start: np.ndarray, lengths: np.ndarray, step: int = 1):
    """The order of the strings by length, their starts in it, and which is the first that has a whole step i, for i = 0, 1, ..."""
    order = np.argsort(lengths, kind="stable")
    steps = lengths[order] // step
    return order, start[order], np.searchsorted(steps, np.arange(steps[-1] if len(steps) else 0), side="right")


def bloom_hashes(keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two xor-then-multiply hashes modulo 2^64 of each key."""
    return bloom_hashes_at(*joined(keys))


def bloom_hashes_at(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bloom_hashes`` of strings that lie in ``data``."""
    h1, h2 = np.full(len(start), OFFSET, np.uint64), np.full(len(start), SECOND_START, np.uint64)
    order, start, longer = _by_length(start, lengths)
    with np.errstate(over="ignore"):
        for i, at in enumerate(longer):
            b = data[start[at:] + i]
            h1[at:] = (h1[at:] ^ b) * np.uint64(PRIME)
            h2[at:] = (h2[at:] ^ b) * np.uint64(SECOND_PRIME)
    back = np.argsort(order)
    return h1[back], h2[back]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _four_bytes(c: np.ndarray) -> np.ndarray:
    for _ in range(4):
        c = _CRC[c & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return c


#: What four bytes make of the lower and of the upper half of a state they are already mixed into.
_LOWER, _UPPER = (_four_bytes(np.arange(1 << 16, dtype=np.uint32) << np.uint32(s)) for s in (0, 16))


def crc32c(data: Sequence[bytes]) -> np.ndarray:
    """CRC-32C of each byte string."""
    return ~crc32c_more(np.full(len(data), 0xFFFFFFFF, np.uint32), *joined(data))


def crc32c_more(state: np.ndarray, data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The states of checksums after strings that lie in ``data``; at first all ones, and inverted in the end."""
    order, first, longer = _by_length(start, lengths, 4)
    c = state[order]
    if len(longer):
        words = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
        for i, at in enumerate(longer):
            x = c[at:] ^ words[first[at:] + 4 * i]
            c[at:] = _LOWER[x & np.uint32(0xFFFF)] ^ _UPPER[x >> np.uint32(16)]
    rest, end = lengths[order] & 3, first + lengths[order]
    for i in (3, 2, 1):
        rows = np.flatnonzero(rest >= i)
        c[rows] = _CRC[(c[rows] ^ data[end[rows] - i]) & np.uint32(0xFF)] ^ (c[rows] >> np.uint32(8))
    state = np.empty_like(c)
    state[order] = c
    return state
