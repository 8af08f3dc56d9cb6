"""Ordering many suffixes of a byte buffer by their first ``width`` bytes: deep-shallow sorting.

Shallow part: multikey quicksort steps over 8-byte characters, each splitting the groups that are still equal, down
to a fixed depth. Deep part: a group whose members share that long prefix goes into a blind trie (a Patricia trie
that keeps only branching depths and branching bytes), whose leaves in order complete the sort. Members equal in all
``width`` bytes end in one leaf, which is one class of the result.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 40  # bytes sorted by multikey quicksort


def _words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one big-endian number (zero-padded at the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text), ">u8", padded, strides=(1,)).astype(np.uint64)


def _open_groups(head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the members of groups of two or more, start of each such group among them, its size)."""
    places = np.flatnonzero(~(head & np.append(head[1:], True)))
    first = np.flatnonzero(head[places])
    return places, first, np.diff(np.append(first, len(places)))


def shallow_sort(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``at`` by their first ``depth`` bytes (a multiple of 8) and the heads of equal groups."""
    key = words[at]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(len(at), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    for level in range(8, depth, 8):
        open_, first, sizes = _open_groups(head)
        if len(open_) == 0:
            break
        members = order[open_]
        key = words[at[members] + level]
        group = np.repeat(np.arange(len(first)), sizes)
        mixed = np.zeros(len(first), dtype=bool)
        mixed[group[key != np.repeat(key[first], sizes)]] = True  # a group with one key stays as it is
        pick = mixed[group]
        if not pick.any():
            continue
        open_, members, key, group = open_[pick], members[pick], key[pick], group[pick]
        sub = np.lexsort((key, group))
        order[open_] = members[sub]
        group, key = group[sub], key[sub]
        split = np.ones(len(sub), dtype=bool)
        split[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        head[open_] = split
    return order, head


class BlindTrie:
    """Blind trie over equally long keys given as big-endian integers of ``n_bytes`` bytes."""

    def __init__(self, n_bytes: int):
        self.n_bytes, self.bits, self.root = n_bytes, 8 * n_bytes, None

    def _byte(self, key: int, depth: int) -> int:
        return (key >> (self.bits - 8 * depth - 8)) & 255

    def insert(self, key: int, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (key, [member])
            return
        path = []
        while type(node[1]) is dict:  # blind descent: only branching bytes are looked at
            path.append(node)
            children = node[1]
            node = children.get(self._byte(key, node[0])) or next(iter(children.values()))
        differ = key ^ node[0]
        if not differ:
            node[1].append(member)
            return
        common = (self.bits - differ.bit_length()) >> 3
        leaf, mine = (key, [member]), self._byte(key, common)
        theirs = self._byte(node[0], common)
        below = node
        while path and path[-1][0] > common:
            below = path.pop()
        if path and path[-1][0] == common:
            path[-1][1][mine] = leaf
            return
        branch = (common, {theirs: below, mine: leaf})
        if path:
            path[-1][1][self._byte(key, path[-1][0])] = branch
        else:
            self.root = branch

    def leaves(self):
        """The members of each leaf, in key order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node[1]) is dict:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node[1]


def order_suffixes(text: np.ndarray, at: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``at`` by their first ``width`` bytes, and the heads of the classes that agree in them.

    Every suffix must have ``width`` bytes in ``text``.
    """
    if len(at) == 0:
        return np.zeros(0, np.int64), np.zeros(0, dtype=bool)
    depth = min(shallow, width) // 8 * 8
    words = _words_at(text)
    if depth:
        order, head = shallow_sort(words, at, depth)
    else:
        order, head = np.arange(len(at)), np.zeros(len(at), dtype=bool)
        head[0] = True
    rest = width - depth
    if rest == 0:
        return order, head
    # rest of each key that shares its first bytes, as 8-byte characters, the last one cut to the bytes that count
    open_, first, sizes = _open_groups(head)
    members = order[open_]
    tails = []
    for level in range(depth, width, 8):
        w, n = words[at[members] + level], min(8, width - level)
        tails.append(w >> np.uint64(8 * (8 - n)) if n < 8 else w)
    same = np.ones(len(members), dtype=bool)
    for t in tails:
        same &= t == np.repeat(t[first], sizes)
    # groups with one key in all members are one class already
    mixed = np.unique(np.repeat(np.arange(len(first)), sizes)[~same])
    shifts = [8 * min(8, width - level) for level in range(depth, width, 8)]
    for lo, hi in zip(first[mixed].tolist(), (first + sizes)[mixed].tolist()):
        trie, parts, begin = BlindTrie(rest), [t[lo:hi].tolist() for t in tails], int(open_[lo])
        for m, key in enumerate(zip(*parts)):
            number = 0
            for part, shift in zip(key, shifts):
                number = (number << shift) | part
            trie.insert(number, m)
        placed, heads = [], []
        for leaf in trie.leaves():
            heads.append(len(placed))
            placed += leaf
        order[open_[lo:hi]] = members[lo:hi][placed]
        head[begin + np.array(heads)] = True
    return order, head
