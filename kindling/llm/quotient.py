"""Counting quotient filters of packed word-id n-grams.

An n-gram of up to three word ids (from 1; 0: no word) of ``size / 3`` bits each is packed into one key of ``size`` bits (up
to 126), held as ``lo`` (the last 64) and ``hi`` (what is beyond). The packed key is *permuted* by an invertible map of
the ``size``-bit numbers, so that keys spread evenly and no key is lost. Of the permuted ``lo`` the first bits name the
bucket a key is dealt to and the next ones its quotient there; the remainder is all that is left of the key. A filter of
a bucket keeps, in key order:

* ``occupied``: one bit per quotient, set if the quotient has keys;
* ``run ends``: one bit per key, set at the last key of its quotient;
* the remainder of each key, in whole bytes, and its count: one byte, with a list of the larger counts behind.

With 400,000 words that is about 7 bytes a key, from which key and count are read back exactly. Filters are sorted, so
merging those of many shards is merging sorted runs.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_TIMES = (0xE9846AF9B1A615D, 0x9FB21C651E98DF25)  # any odd factors
_SPREAD, _SHIFT = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def _mix(x: np.ndarray, size: int = 64, back: bool = False) -> np.ndarray:
    """Invertible mixing of ``size``-bit numbers (``back``: the inverse): shifts by half the width undo themselves."""
    mask, half = U((1 << size) - 1), U((size + 1) // 2)
    x = x ^ (x >> half)
    for factor in reversed(_TIMES) if back else _TIMES:
        x = (x * U(pow(factor, -1, 1 << 64) if back else factor)) & mask
        x ^= x >> half
    return x


def permute(hi: np.ndarray, lo: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Invertible map of ``size``-bit keys: beyond 64 bits each step changes one half by what the other half says."""
    if size <= 64:
        return hi, _mix(lo, size)
    lo = _mix(lo + hi * _SPREAD)
    hi = hi ^ (_mix(lo ^ _SHIFT) >> U(128 - size))
    return hi, _mix(lo ^ (hi * _SHIFT))


def restore(hi: np.ndarray, lo: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that :func:`permute` maps to these."""
    if size <= 64:
        return hi, _mix(lo, size, back=True)
    lo = _mix(lo, back=True) ^ (hi * _SHIFT)
    hi = hi ^ (_mix(lo ^ _SHIFT) >> U(128 - size))
    return hi, _mix(lo, back=True) - hi * _SPREAD


def pack(ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the keys of three id arrays."""
    width = size // 3
    hi, lo = np.zeros_like(ids[0]), np.zeros_like(ids[0])
    for w, at in zip(ids, (2 * width, width, 0)):
        if at < 64:
            lo = lo | (w << U(at))
            if at and at + width > 64:
                hi = hi | (w >> U(64 - at))
        else:
            hi = hi | (w << U(at - 64))
    return hi, lo


def unpack(hi: np.ndarray, lo: np.ndarray, size: int) -> list[np.ndarray]:
    """The three id arrays of keys."""
    width = size // 3
    mask = U((1 << width) - 1)
    out = []
    for at in (2 * width, width, 0):
        w = lo >> U(at) if at < 64 else hi >> U(at - 64)
        if 0 < at < 64 < at + width:
            w = w | (hi << U(64 - at))
        out.append(w & mask)
    return out


def count_keys(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct permuted keys in ascending order of (lo, hi), with their summed counts (each key counts 1 by default)."""
    if len(lo) == 0:
        return hi, lo, np.zeros(0, np.int64)
    order = np.argsort(lo, kind="stable")
    hi, lo = hi[order], lo[order]
    head = np.ones(len(lo), dtype=bool)
    head[1:] = lo[1:] != lo[:-1]
    if (~head[1:] & (hi[1:] != hi[:-1])).any():  # keys that share lo: order them by hi too
        more = np.lexsort((hi, lo))
        hi, lo, order = hi[more], lo[more], order[more]
        head[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    at = np.flatnonzero(head)
    n = np.diff(np.append(at, len(lo))) if counts is None else np.add.reduceat(counts[order], at)
    return hi[at], lo[at], n.astype(np.int64)


def bucket_edges(lo: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, from, to) of the non-empty ones of 2**bits buckets of ascending permuted keys."""
    b = (lo >> U(min(size, 64) - bits)).astype(np.int64) if bits else np.zeros(len(lo), np.int64)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    return b[at], at, np.append(at[1:], len(b)).astype(np.int64)


def write_filter(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, bits: int, size: int) -> bytes:
    """The filter of ascending distinct permuted keys of one of the 2**bits buckets."""
    n, low = len(lo), min(size, 64)
    q = min(int(max(n - 1, 0)).bit_length(), low - bits)  # quotients: as many as keys, or up to twice
    left = low - bits - q  # bits of lo in the remainder
    quotient = (lo >> U(left) if left < 64 else np.zeros(n, U)) & U((1 << q) - 1)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.ones(n, dtype=bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    bytes_of = lambda x, width: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    small = np.where(counts < 256, counts, 0).astype(np.uint8)  # 0: in the list of large counts
    large = counts[counts >= 256].astype("<u8")
    return b"".join([np.array([n, q, len(large)], "<u4").tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                     bytes_of(lo & U((1 << left) - 1), (left + 7) // 8), bytes_of(hi, (size - low + 7) // 8), small.tobytes(),
                     large.tobytes()])


def read_filter(raw: bytes, bucket: int, bits: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending permuted keys and counts that :func:`write_filter` wrote."""
    n, q, n_large = np.frombuffer(raw, "<u4", 3).tolist()
    low, at = min(size, 64), 12
    left = low - bits - q

    def take(count: int) -> np.ndarray:
        nonlocal at
        at += count
        return np.frombuffer(raw, np.uint8, count, at - count)

    def numbers(width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = take(n * width).reshape(n, width)
        return out.reshape(-1).view("<u8").astype(U)

    occupied = np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q)
    ends = np.unpackbits(take((n + 7) // 8), count=n)
    lo, hi = numbers((left + 7) // 8), numbers((size - low + 7) // 8)
    counts = take(n).astype(np.int64)
    counts[counts == 0] = take(8 * n_large).copy().view("<u8").astype(np.int64)
    run = np.cumsum(ends, dtype=np.int64) - ends  # which occupied quotient a key belongs to
    if left < 64:
        lo |= (np.flatnonzero(occupied).astype(U)[run] | U(bucket << q)) << U(left)
    return hi, lo, counts


def merge_filters(filters: list[bytes], bucket: int, bits: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and summed counts of several filters of one bucket, in ascending order: a merge of their sorted runs."""
    parts = [read_filter(raw, bucket, bits, size) for raw in filters]
    if not parts:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    return count_keys(*(np.concatenate(x) for x in zip(*parts)))
