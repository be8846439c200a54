"""Vectorised arithmetic over GF(p), p = 2^31 - 1, for characteristic-polynomial sketches."""

from __future__ import annotations

import numpy as np

P = (1 << 31) - 1
#: The top of the field is kept for sample points, so that no element is ever one.
SAMPLES = 1 << 16


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of ``h`` under ``seed``."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def elements(h: np.ndarray, seed: int) -> np.ndarray:
    """Field elements below the sample points for 64-bit hashes ``h``."""
    return (mix(h, seed) % np.uint64(P - SAMPLES)).astype(np.int64)


def points(m: int) -> np.ndarray:
    return P - 1 - np.arange(m, dtype=np.int64)


def inverse(a: np.ndarray) -> np.ndarray:
    """a^(p-2) by square and multiply."""
    out, base, e = np.ones_like(a), a % P, P - 2
    while e:
        if e & 1:
            out = out * base % P
        base = base * base % P
        e >>= 1
    return out


def segment_products(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products mod p of the rows of ``f`` over the segments that begin at ``starts``.

    Rows are multiplied in pairs until each segment is one row: log2 of the longest segment passes.
    """
    lengths = np.diff(np.append(starts, len(f)))
    while len(lengths) and lengths.max() > 1:
        pos = np.arange(len(f)) - np.repeat(starts, lengths)
        even = np.flatnonzero(pos % 2 == 0)
        paired = pos[even] + 1 < np.repeat(lengths, lengths)[even]
        out = f[even]
        out[paired] = out[paired] * f[even[paired] + 1] % P
        f, lengths = out, (lengths + 1) // 2
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return f


def evaluate(coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row i of ``coefficients`` (constant first) at x[i]."""
    out = np.zeros_like(x)
    for c in range(coefficients.shape[1] - 1, -1, -1):
        out = (out * x + coefficients[:, c]) % P
    return out


def interpolate(ratio: np.ndarray, difference: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Monic polynomials num, den with num/den = ``ratio`` at points(m), deg num - deg den = ``difference``.

    ``ratio`` is (b, m), ``difference`` (b). Returns (num, den, ok): coefficients (b, m + 1), constant
    first, and whether a solution exists within degree m. Where the true degrees are smaller, both
    carry the same arbitrary factor.
    """
    b, m = ratio.shape
    total = m - (m - difference) % 2
    dn, dd = (total + difference) // 2, (total - difference) // 2
    ok = (dn >= 0) & (dd >= 0)
    dn, dd = np.where(ok, dn, 0), np.where(ok, dd, 0)
    powers = np.ones((m + 1, m), np.int64)
    for i in range(1, m + 1):
        powers[i] = powers[i - 1] * points(m) % P
    a = np.zeros((b, m, m + 1), np.int64)
    negative = (P - ratio) % P
    for c in range(m):
        in_num = c < dn
        in_den = ~in_num & (c < dn + dd)
        a[in_num, :, c] = powers[c]
        if in_den.any():
            a[in_den, :, c] = negative[in_den] * powers[c - dn[in_den]] % P
    a[:, :, m] = (ratio * powers[dd] - powers[dn]) % P
    rank, pivot_of, each = np.zeros(b, np.int64), np.full((b, m), -1), np.arange(b)
    for c in range(m):
        column = a[:, :, c]
        usable = (column != 0) & (np.arange(m)[None, :] >= rank[:, None])
        has = usable.any(axis=1)
        row = usable.argmax(axis=1)
        w = each[has]
        if not len(w):
            continue
        r0, r1 = rank[w], row[w]
        a[w, r0], a[w, r1] = a[w, r1].copy(), a[w, r0].copy()
        lead = a[w, r0] * inverse(a[w, r0, c])[:, None] % P
        factor = a[w, :, c].copy()
        factor[np.arange(len(w)), r0] = 0
        a[w, r0] = lead
        a[w] = (a[w] - factor[:, :, None] * lead[:, None, :]) % P
        pivot_of[w, c] = r0
        rank[w] += 1
    rest = np.arange(m)[None, :] >= rank[:, None]
    ok &= ~((a[:, :, m] != 0) & rest).any(axis=1)
    solution = np.where(pivot_of >= 0, np.take_along_axis(a[:, :, m], np.maximum(pivot_of, 0), axis=1), 0)
    num, den = np.zeros((b, m + 1), np.int64), np.zeros((b, m + 1), np.int64)
    for c in range(m):
        in_num = c < dn
        in_den = ~in_num & (c < dn + dd)
        num[in_num, c] = solution[in_num, c]
        den[each[in_den], c - dn[in_den]] = solution[in_den, c]
    num[each, dn], den[each, dd] = 1, 1
    return num, den, ok
