"""Vectorised text helpers: words, rolling hashes and ranges over the buffers of Arrow string columns.

Everything here works on a *block*: the UTF-8 bytes of some documents end to end (``data``, uint8) and the
document offsets into it (``offs``, int64, one more than documents). Hash arithmetic is modulo 2**64, which
numpy gives for free; every hash is finalised by :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: bases of the rolling hashes (any odd numbers do)
BASE_BYTES, BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U(32))
    x = x * U(0xE9846AF9B1A615D)
    x ^= x >> U(32)
    x *= U(0xE9846AF9B1A615D)
    x ^= x >> U(28)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE_A))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n (kept and grown per process)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up = np.full(size, base, dtype=U)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=U)
        up[0] = down[0] = U(1)
        have = _POWERS[base] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; one entry more than values."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:], dtype=U)
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Position-independent hash of each range [start, end) under ``prefix``."""
    return mix((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts])


def string_block(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, max_bytes: int = BLOCK_BYTES,
           max_rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``max_bytes`` and at most ``max_rows`` (a longer document is a run of its own)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, i + (max_rows or n))
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, per-document word offsets) of the maximal runs of non-separator bytes of each document."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    sep = separator[data]
    edge = np.ones(len(data) + 1, dtype=bool)  # a byte's left neighbour is a separator or another document
    edge[1:-1] = sep[:-1]
    edge[offs] = True
    starts = np.flatnonzero(edge[:-1] & ~sep)
    edge = np.ones(len(data) + 1, dtype=bool)  # the same for the right neighbour
    edge[:-1] = sep
    edge[offs] = True
    ends = np.flatnonzero(edge[1:] & ~sep) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(BYTE_VALUES[data], BASE_BYTES), starts, ends, BASE_BYTES)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count of them) for each start, end to end."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def windows(item_offs: np.ndarray, width: int) -> np.ndarray:
    """Start index of every run of ``width`` consecutive items that stays inside one document."""
    return expand(item_offs[:-1], np.maximum(np.diff(item_offs) - width + 1, 0))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean cover of [0, n) by [start, start + width) for all starts (clipped at n)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:-1]) > 0
