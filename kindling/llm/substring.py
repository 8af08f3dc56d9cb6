"""Substring dedup over words, by difference-cover anchors.

A difference cover D modulo a period v holds, for every d, two elements that differ by d modulo v. Hash only the
runs of ``width - v + 1`` words that start at a position p of their document with p mod v in D. Two equal runs of
``width`` words at positions i and j then have an offset below v at which both start an anchor, whatever i and j
are; so every repeated run shows up as a repeated anchor, from a fraction |D| / v of all positions. Repeated
anchors are extended: the runs of ``width`` words around them are hashed (128 bits) and those that occur again
anywhere, in the same document included, cover their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm import exchange as X
from kindling.llm import textarrays as TA

#: perfect difference sets (fixed values): every residue is the difference of two elements
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(width: int) -> tuple[int, np.ndarray]:
    """Period and cover for runs of ``width`` words: the largest period of at most two fifths of it."""
    period = max(v for v in COVERS if v == 1 or v <= (width + 1) * 0.4)
    return period, np.array(COVERS[period])


class _Anchors:
    """Anchors of one document group: distinct hashes and, per block, where they start."""

    def __init__(self, texts, width: int):
        self.width = width
        self.period, cover = cover_for(width)
        self.len = width - self.period + 1
        in_cover = np.zeros(self.period, dtype=bool)
        in_cover[cover] = True
        data, offs = TA.string_block(texts)
        self.parts, found = [], []
        for i, j, d, o in TA.blocks(data, offs):
            s, e, wo = TA.words(d, o)
            h = TA.word_hashes(d, s, e)
            p = TA.prefix_hash(h, TA.BASE_A)
            at = TA.windows(wo, self.len)
            doc_start = wo[np.searchsorted(wo, at, side="right") - 1]
            at = at[in_cover[(at - doc_start) % self.period]]
            found.append(TA.range_hash(p, at, at + self.len, TA.BASE_A))
            self.parts.append((i, j, d, s, e, wo, h, p, at))
        self.sizes = [len(f) for f in found]
        (self.keys,), self.place, self.counts = X.distinct(np.concatenate(found) if found else np.zeros(0, X.U))

    def extended(self, repeated: np.ndarray):
        """Runs of ``width`` words around the repeated anchors: per block their starts, and all their hashes."""
        flags, k, starts, h1, h2 = repeated[self.place], 0, [], [], []
        for (i, j, d, s, e, wo, h, p, at), n in zip(self.parts, self.sizes):
            hit, k = at[flags[k:k + n]], k + n
            runs = TA.windows(wo, self.width)
            near = np.zeros(len(s) + 1, np.int64)  # a run starts at most period - 1 before a repeated anchor
            np.add.at(near, np.maximum(hit - self.period + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            runs = runs[np.cumsum(near)[runs] > 0]
            starts.append(runs)
            h1.append(TA.range_hash(p, runs, runs + self.width, TA.BASE_A))
            h2.append(TA.range_hash(TA.prefix_hash(h, TA.BASE_B), runs, runs + self.width, TA.BASE_B))
        empty = [np.zeros(0, X.U)]
        return starts, X.distinct(np.concatenate(h1 or empty), np.concatenate(h2 or empty))


def join_words(d: np.ndarray, s: np.ndarray, e: np.ndarray, keep: np.ndarray, wo: np.ndarray) -> list[str]:
    """The kept words of each document joined by one space."""
    n_kept = np.concatenate([[0], np.cumsum(keep)])
    s, lens = s[keep], (e - s)[keep] + 1
    padded = np.append(d, np.uint8(0x20))
    out = padded[np.minimum(TA.expand(s, lens), len(d))] if len(s) else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    out[ends[1:] - 1] = 0x20
    raw, bounds = out.tobytes(), ends[n_kept[wo]]
    return [raw[a:b - 1].decode() if b > a else "" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35,
                    group_bytes: int = X.GROUP_BYTES) -> DataFrame:
    """Remove every word covered by a run of ``width`` words (``[^\\x20\\x09-\\x0D]+``) that occurs again anywhere.

    Returns one row per input row: the id column, n_words, n_removed, kept_text (kept words joined by one space)
    and spans (removed word ranges, start inclusive, end exclusive). Runs are judged on the input, not on what is
    left. A null or empty text has no words and gives ''. Rows that repeat an id are documents of their own; rows
    equal in id and text repeat each other like any two copies. Other columns are ignored; an empty table gives
    an empty result. Exact up to collisions of 128-bit hashes of 64-bit word hashes.
    """
    d, n_groups = X.deal_groups(docs, id_col, text_col, group_bytes)
    n_buckets = n_groups // 2 + 1
    id_type = docs.schema[id_col].dataType

    def ask_anchors(table: pa.Table) -> pa.Table:
        a = _Anchors(table.column("text"), width)
        return X.ask_table(table.column("g")[0].as_py(), 1, [a.keys], n_buckets)

    def runs_of(a: _Anchors, answers: pa.Table):
        return a.extended((a.counts > 1) | X.answered(answers, 1, a.keys, n_buckets))

    def ask_runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, (keys, _, _) = runs_of(_Anchors(table.column("text"), width), answers)
        return X.ask_table(table.column("g")[0].as_py(), 2, keys, n_buckets)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        a = _Anchors(table.column("text"), width)
        starts, (keys, place, counts) = runs_of(a, answers)
        repeated = ((counts > 1) | X.answered(answers, 2, keys[0], n_buckets))[place]
        texts, n_words, n_removed, spans, k = [], [], [], [], 0
        for (i, j, data, s, e, wo, *_), runs in zip(a.parts, starts):
            gone = TA.covered(runs[repeated[k:k + len(runs)]], width, len(s))
            k += len(runs)
            texts += join_words(data, s, e, ~gone, wo)
            n_words.append(np.diff(wo))
            total = np.concatenate([[0], np.cumsum(gone)])
            n_removed.append(np.diff(total[wo]))
            edge = np.zeros(len(s) + 1, dtype=bool)
            edge[wo] = True
            first = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone))
            last = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]) if len(gone) else gone)) + 1
            of = np.searchsorted(wo, first, side="right") - 1
            cut = np.searchsorted(of, np.arange(len(wo)))
            base = wo[of]
            first, last = (first - base).tolist(), (last - base).tolist()
            spans += [[{"start": x, "end": y} for x, y in zip(first[p:q], last[p:q])]
                      for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())]
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"id": table.column("id"), "n_words": pa.array(cat(n_words), pa.int64()),
                         "n_removed": pa.array(cat(n_removed), pa.int64()), "kept_text": pa.array(texts, pa.string()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    def answers_to(asked: DataFrame, n_keys: int) -> DataFrame:
        return asked.groupBy("b").applyInArrow(X.shared_elsewhere(n_keys), X.ASK_SCHEMA)

    anchors = answers_to(d.groupBy("g").applyInArrow(ask_anchors, X.ASK_SCHEMA), 1)
    runs = answers_to(d.groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(ask_runs, X.ASK_SCHEMA), 2)
    out = d.groupBy("g").cogroup(anchors.unionByName(runs).groupBy("g")).applyInArrow(
        finish, f"id {id_type.simpleString()}, n_words long, n_removed long, kept_text string, "
                "spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)
