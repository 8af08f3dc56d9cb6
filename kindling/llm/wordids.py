"""Distinct words of a block of texts, exactly: equal hashes are confirmed on the bytes themselves."""

from __future__ import annotations

import numpy as np

from kindling.llm import exchange as X
from kindling.llm import textarrays as TA

U = np.uint64


def _cuts(starts: np.ndarray, ends: np.ndarray, limit: int = TA.BLOCK_BYTES) -> list[tuple[int, int]]:
    """Runs of words (ascending) that span about ``limit`` bytes; a longer word is a run of its own."""
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        out.append((i, j))
        i = j
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                   kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct word, place of every word among them).

    Words are equal if their bytes and their ``kind`` (a small integer, e.g. the language of the text) are. They are
    grouped by a 64-bit hash; every word is then compared with the word that stands for its group, and a group that
    mixes words is taken apart by their bytes. The words lie in ``data`` in ascending order.
    """
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts
    salt = size.astype(U) if kind is None else size.astype(U) | (kind.astype(U) << U(40))
    key = TA.mix(salt + U(1))
    cuts = _cuts(starts, ends)
    for i, j in cuts:  # bounds the memory of the rolling hashes
        lo = starts[i]
        key[i:j] ^= TA.word_hashes(data[lo:ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo)
    _, place, _ = X.distinct(TA.mix(key))
    _, first = np.unique(place, return_index=True)
    other = first[place]
    same = size == size[other]
    if kind is not None:
        same &= kind == kind[other]
    for i, j in cuts:
        check = np.flatnonzero(same[i:j]) + i
        differ = data[TA.expand(starts[check], size[check])] != data[TA.expand(starts[other[check]], size[check])]
        if differ.any():
            same[check[np.unique(np.repeat(np.arange(len(check)), size[check])[differ])]] = False
    if not same.all():  # two words of one hash: by their bytes
        seen: dict = {}
        for i in np.flatnonzero(np.isin(place, place[~same])).tolist():
            word = (0 if kind is None else int(kind[i]), data[starts[i]:ends[i]].tobytes())
            place[i] = seen.setdefault((int(place[i]), word), len(first) + len(seen))
        _, first, place = np.unique(place, return_index=True, return_inverse=True)
    return first, place
