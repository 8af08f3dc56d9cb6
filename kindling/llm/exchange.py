"""Asking, by shuffle, whether a hash of one document group also occurs in another group.

Documents are dealt into *groups* of a bounded number of text bytes by a hash of id and text (rows that are
equal in both stay together, which is harmless: they get equal answers). A group asks one question per
distinct hash; the questions are dealt by hash value into *buckets* of bounded size as one binary row per
(group, bucket); a bucket answers each row with one bit per question. A text, line or passage that a third of
all documents hold therefore puts at most one question per group into its bucket, and nothing but bits travels
back. Answers are aligned with the *sorted distinct* hashes of a group, so they stay valid whatever order a
re-run task reads its rows in. All steps are lazy; Spark reuses the exchange of the grouped documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
GROUP_BYTES = 8 << 20
ASK_SCHEMA = "b long, g long, kind int, payload binary"


def deal_groups(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES,
                carry: tuple = ()) -> tuple[DataFrame, int]:
    """(g, id, text, c0, c1, ... for ``carry``) and the number of groups: text bytes / ``group_bytes``, at least 1."""
    more = [f"c{i}" for i in range(len(carry))]
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                    *[docs[c].alias(a) for c, a in zip(carry, more)])
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // group_bytes) + 1
    return d.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("long").alias("g"), "id", "text", *more), n


def bucket_bounds(n: int) -> np.ndarray:
    """Lower bound of each of ``n`` equal ranges of 64-bit hash values (n < 2**32)."""
    return np.array([(i << 64) // n for i in range(n)], dtype=U)


def bucket_slices(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, from, to) of the non-empty buckets of an ascending array of hashes."""
    b = ((first >> U(32)) * U(n) >> U(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    return b[cut], cut, np.append(cut[1:], len(b)).astype(np.int64)


def distinct(*keys: np.ndarray, hashed: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct tuples of ``keys`` in ascending order, the place of each input tuple among them, their counts.

    ``hashed`` says that tuples of one first key are nearly always equal: the other keys are only sorted if not."""
    if len(keys[0]) == 0:
        return [k for k in keys], np.zeros(0, np.int64), np.zeros(0, np.int64)
    # quicker than a stable sort; equal tuples are one row whatever their order
    order = np.argsort(keys[0]) if hashed or len(keys) == 1 else np.lexsort(keys[::-1])
    if hashed and len(keys) > 1:
        tied = np.diff(keys[0][order]) == 0
        if any(np.any(tied & (np.diff(k[order]) != 0)) for k in keys[1:]):  # first hashes that are equal by chance
            order = np.lexsort(keys[::-1])
    head = np.zeros(len(order), dtype=bool)
    head[0] = True
    ordered = [k[order] for k in keys]
    for k in ordered:
        head[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(head)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(head) - 1
    return [k[at] for k in ordered], place, np.diff(np.append(at, len(order)))


def ask_table(g: int, kind: int, keys: list[np.ndarray], n_buckets: int) -> pa.Table:
    """One row per non-empty bucket: the arrays of ``keys`` (first one ascending), one after the other."""
    b, lo, hi = bucket_slices(keys[0], n_buckets) if len(keys[0]) else (np.zeros(0, np.int64),) * 3
    payload = [b"".join(k[i:j].tobytes() for k in keys) for i, j in zip(lo.tolist(), hi.tolist())]
    n = len(payload)
    return pa.table({"b": pa.array(b, pa.int64()), "g": pa.array(np.full(n, g, np.int64)),
                     "kind": pa.array(np.full(n, kind, np.int32)), "payload": pa.array(payload, pa.binary())})


def payload_arrays(table: pa.Table, dtypes: list) -> tuple[list[np.ndarray], np.ndarray]:
    """The asked arrays of all rows end to end, and the offsets of the rows in them."""
    width = sum(np.dtype(t).itemsize for t in dtypes)
    rows = [x.as_py() for x in table.column("payload").combine_chunks()] if table.num_rows else []
    sizes = np.array([len(r) // width for r in rows], dtype=np.int64)
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out, before = [], 0
    for t in dtypes:
        w = np.dtype(t).itemsize
        parts = [np.frombuffer(r, t, n, n * before) for r, n in zip(rows, sizes.tolist())]
        out.append(np.concatenate(parts) if parts else np.zeros(0, t))
        before += w
    return out, offs


def answer_table(asked: pa.Table, flags: np.ndarray, offs: np.ndarray) -> pa.Table:
    """Answers to the asked rows, one bit per question."""
    bits = [np.packbits(flags[i:j]).tobytes() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return pa.table({"b": asked.column("b"), "g": asked.column("g"), "kind": asked.column("kind"),
                     "payload": pa.array(bits, pa.binary())})


def shared_elsewhere(n_keys: int):
    """Bucket step: flags the questions (of ``n_keys`` 64-bit hashes each) that more than one group asked."""
    def answer(table: pa.Table) -> pa.Table:
        keys, offs = payload_arrays(table, [U] * n_keys)
        _, place, counts = distinct(*keys)
        return answer_table(table, counts[place] > 1 if len(place) else np.zeros(0, bool), offs)
    return answer


def answered(answers: pa.Table, kind: int, first: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bits for the ascending distinct hashes ``first`` of this group (all False where none came back)."""
    out = np.zeros(len(first), dtype=bool)
    if answers.num_rows == 0 or len(first) == 0:
        return out
    kinds, b = answers.column("kind").to_numpy(), answers.column("b").to_numpy()
    payload = answers.column("payload")
    rows = {int(b[i]): payload[int(i)].as_py() for i in np.flatnonzero(kinds == kind)}
    for x, lo, hi in zip(*(a.tolist() for a in bucket_slices(first, n_buckets))):
        out[lo:hi] = np.unpackbits(np.frombuffer(rows[x], np.uint8), count=hi - lo).astype(bool)
    return out
