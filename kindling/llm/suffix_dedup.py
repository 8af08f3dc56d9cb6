"""Suffix-array dedup over bytes: remove what a document with a smaller id already holds.

A distributed suffix array of all bytes would carry ``width`` bytes for every byte of the corpus. Three steps keep
only the suffixes whose order can matter:

1. *Cells.* Content-defined cuts split each document into cells of about 64 bytes. A cell with the ``width - 1``
   bytes after it holds every string that starts in it, so copies of a cell in documents with larger ids are
   covered as a whole; only the copy of the smallest id goes on.
2. *Segments.* The least hash of the k-grams of a ``width``-byte string depends on the string alone. Strings whose
   least hash occurs once in the corpus occur once themselves; runs of the others are segments.
3. *Suffix arrays.* Segments are dealt by that hash, equal strings meet in one task, and a deep-shallow sort of all
   suffixes there puts equal ``width``-byte prefixes next to each other; every suffix that is not of its class's
   smallest id is covered. A hash that very many segments share is dealt by the whole string instead, one row for
   each distinct string of a group, with the group's smallest id; the group answers for its other copies itself.

Cells and hashes travel as in :mod:`kindling.llm.exchange`; the answers are bits or ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindling.llm import exchange as X
from kindling.llm import textarrays as TA
from kindling.llm.suffixes import order_suffixes

U = np.uint64
CUT_GRAM, CUT_EVERY = 16, 64  # CUT_EVERY: a power of two
NO_ID = np.int64(2**63 - 1)  # documents without an id come last
SIGN = U(1 << 63)
GROUP_BYTES = 4 << 20
BLOCK_BYTES = 1 << 16  # bytes hashed at once: their 64-bit hashes stay in the processor's cache
HEAVY = 20_000  # segments of one hash beyond which they are dealt by whole strings


def _grams(prefix: np.ndarray, n: int, k: int) -> np.ndarray:
    """:func:`TA.range_hash` of all ranges of ``k`` bytes, by slices."""
    many = max(n - k + 1, 0)
    return TA.mix((prefix[k:k + many] - prefix[:many]) * TA.powers(TA.BASE_BYTES, len(prefix))[1][:many])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


class _Cells:
    """One document group in a fixed order (id, text), with its cells."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.table, self.width = table, width
        self.data, self.offs = TA.string_block(table.column("text"))
        self.ids = table.column("id").combine_chunks().fill_null(NO_ID).to_numpy().astype(np.int64)
        starts, ends, h1, h2, owner = [], [], [], [], []
        for i, j, d, o in TA.blocks(self.data, self.offs, BLOCK_BYTES):
            if len(d) == 0:
                continue
            p = TA.prefix_hash(TA.BYTE_VALUES[d], TA.BASE_BYTES)
            cut = np.zeros(len(d), dtype=bool)
            grams = _grams(p, len(d), CUT_GRAM)
            cut[:len(grams)] = grams & U(CUT_EVERY - 1) == 0
            cut[o[:-1][np.diff(o) > 0]] = True
            s = np.flatnonzero(cut)
            e = np.append(s[1:], len(d))
            doc = np.searchsorted(o, s, side="right") - 1
            full = s + width <= o[doc + 1]  # cells in which a whole string starts
            s, e, doc = s[full], e[full], doc[full]
            till = np.minimum(e + width - 1, o[doc + 1])
            h1.append(TA.range_hash(p, s, till, TA.BASE_BYTES))
            h2.append(TA.range_hash(TA.prefix_hash(TA.BYTE_VALUES[d], TA.BASE_B), s, till, TA.BASE_B))
            starts.append(s + self.offs[i])
            ends.append(np.minimum(e, o[doc + 1] - width + 1) + self.offs[i])
            owner.append(doc + i)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends, self.owner = cat(starts, np.int64), cat(ends, np.int64), cat(owner, np.int64)
        self.keys, self.place, _ = X.distinct(cat(h1, U), cat(h2, U), hashed=True)
        self.least = np.full(len(self.keys[0]), NO_ID)
        np.minimum.at(self.least, self.place, self.ids[self.owner])

    def questions(self) -> list[np.ndarray]:
        return [*self.keys, self.least.astype(U) ^ SIGN]

    def covered_cells(self, answers: pa.Table, n_buckets: int) -> np.ndarray:
        elsewhere = X.answered(answers, 1, self.keys[0], n_buckets)
        return elsewhere[self.place] | (self.ids[self.owner] > self.least[self.place])

    def window_flags(self, cells: np.ndarray) -> np.ndarray:
        """Positions of the group's bytes at which a string of one of ``cells`` starts."""
        flags = np.zeros(len(self.data), dtype=bool)
        flags[TA.expand(self.starts[cells], (self.ends - self.starts)[cells])] = True
        return flags

    def segments(self, fresh: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, strings, hash) of the runs of strings of ``fresh`` positions that share their least hash."""
        starts, counts, hashes = [], [], []
        for i, j, d, o in TA.blocks(self.data, self.offs, BLOCK_BYTES):
            if len(d) < self.width:
                continue
            p = TA.prefix_hash(TA.BYTE_VALUES[d], TA.BASE_BYTES)
            least = _sliding_min(_grams(p, len(d), gram), self.width - gram + 1)
            at = np.flatnonzero(fresh[self.offs[i]:self.offs[j]][:len(least)])
            if len(at) == 0:
                continue
            opens = np.zeros(len(d) + 1, dtype=bool)  # first bytes of documents
            opens[o] = True
            h = least[at]
            head = np.ones(len(at), dtype=bool)
            head[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | opens[at[1:]]
            head = np.flatnonzero(head)
            starts.append(at[head] + self.offs[i])
            counts.append(np.diff(np.append(head, len(at))))
            hashes.append(TA.mix(h[head]))  # least hashes crowd at the low end, buckets are equal ranges
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        return np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)


def _string_hashes(data: np.ndarray, starts: np.ndarray, width: int, base: int = TA.BASE_A) -> np.ndarray:
    """Hash of the ``width`` bytes from each start on."""
    out = np.zeros(len(starts), U)
    for k in range(width):
        out = TA.mix(out * U(base) + TA.BYTE_VALUES[data[starts + k]])
    return out


def _runs(*places: np.ndarray) -> np.ndarray:
    """Rows of (*places, length): the runs in which all of ``places`` rise by one."""
    head = np.ones(len(places[0]), dtype=bool)
    for p in places:
        head[1:] |= p[1:] != p[:-1] + 1
    first = np.flatnonzero(head)
    return np.stack([*[p[first] for p in places], np.diff(np.append(first, len(head)))], axis=1).astype(np.int64)


def _distinct_strings(cells: _Cells, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, hash, gone, like) of the strings at the ascending positions ``at``.

    ``first`` are the positions of the first copy of each distinct string, which has the group's smallest id as
    documents are ordered by id, and ``hash`` their hashes. ``gone`` are runs (position, length) of the copies with
    larger ids, ``like`` runs (position of the first copy, position, length) of those with the same id.
    """
    keys, place, _ = X.distinct(_string_hashes(cells.data, at, width), _string_hashes(cells.data, at, width, TA.BASE_B),
                                hashed=True)
    first = np.full(len(keys[0]), len(cells.data))
    np.minimum.at(first, place, at)
    origin = first[place]
    id_at = lambda x: cells.ids[np.searchsorted(cells.offs, x, side="right") - 1]
    larger = id_at(at) > id_at(origin)
    same = ~larger & (at != origin)
    return first, keys[0], _runs(at[larger]), _runs(origin[same], at[same])


def _smallest_id(table: pa.Table) -> pa.Table:
    """Bucket step 1: flags the cells that a document with a smaller id holds too."""
    (h1, h2, ids), offs = X.payload_arrays(table, [U, U, U])
    keys, place, _ = X.distinct(h1, h2, hashed=True)
    least = np.full(len(keys[0]), np.iinfo(np.uint64).max, dtype=U)
    np.minimum.at(least, place, ids)
    return X.answer_table(table, ids > least[place] if len(place) else np.zeros(0, bool), offs)


def _segment_counts(heavy: int):
    def answer(table: pa.Table) -> pa.Table:
        """Bucket step 2: flags the hashes that several segments share (kind 2) and those very many share (kind 3)."""
        (hashes, counts), offs = X.payload_arrays(table, [U, np.uint16])
        _, place, _ = X.distinct(hashes)
        total = np.bincount(place, weights=counts)[place] if len(place) else np.zeros(0)
        many = X.answer_table(table, total >= heavy, offs)
        many = many.set_column(2, "kind", pa.array(np.full(many.num_rows, 3, np.int32)))
        return pa.concat_tables([X.answer_table(table, total > 1, offs), many])
    return answer


def _sort_bucket(width: int, shallow: int):
    def sort(table: pa.Table) -> pa.Table:
        """Bucket step 3: suffix array over the segments; answers the covered strings as (document, start, count).

        What a group answers itself (kinds 5 and 6) passes through."""
        sent = table.column("kind").to_numpy() == 4
        own, table = table.filter(pa.array(~sent)), table.filter(pa.array(sent))
        if table.num_rows == 0:
            return own
        row, refs, ids, counts, texts = [], [], [], [], []
        for r, payload in enumerate(table.column("payload").to_pylist()):
            n = int(np.frombuffer(payload, np.int64, 1)[0])
            parts = np.frombuffer(payload, np.int32, 3 * n, 8 + 8 * n).reshape(3, n)
            ids.append(np.frombuffer(payload, U, n, 8))
            refs.append(parts[:2])
            counts.append(parts[2].astype(np.int64))
            row.append(np.full(n, r))
            texts.append(np.frombuffer(payload, np.uint8, offset=8 + 20 * n))
        row, ids, counts, text = (np.concatenate(x) for x in (row, ids, counts, texts))
        refs = np.concatenate(refs, axis=1)
        begin = np.concatenate([[0], np.cumsum(counts + width - 1)])[:-1]
        at = TA.expand(begin, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        order, head = order_suffixes(text, at, width, shallow)
        id_of = ids[owner]
        least = np.minimum.reduceat(id_of[order], np.flatnonzero(head))[np.cumsum(head) - 1]
        gone = np.zeros(len(at), dtype=bool)
        gone[order] = id_of[order] > least
        edge = np.ones(len(gone), dtype=bool)
        edge[1:] = ~gone[:-1] | (owner[1:] != owner[:-1])
        first = np.flatnonzero(gone & edge)
        edge = np.ones(len(gone), dtype=bool)
        edge[:-1] = ~gone[1:] | (owner[1:] != owner[:-1])
        length = np.flatnonzero(gone & edge) - first + 1
        seg = owner[first]
        out = np.stack([refs[0][seg], refs[1][seg] + (at[first] - begin[seg]).astype(np.int32), length.astype(np.int32)], axis=1)
        cut = np.searchsorted(row[seg], np.arange(table.num_rows + 1))
        found = [out[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        out = pa.table({"b": table.column("b"), "g": table.column("g"), "kind": table.column("kind"),
                        "payload": pa.array(found, pa.binary())})
        return pa.concat_tables([out, own.select(out.column_names)])
    return sort


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the characters of which only some bytes go."""
    if len(data) == 0:
        return gone
    head = (data & 0xC0) != 0x80
    head[0] = True
    at = np.flatnonzero(head)
    return np.logical_and.reduceat(gone, at)[np.cumsum(head) - 1]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 24,
                 shallow: int = 40, group_bytes: int = GROUP_BYTES, heavy: int = HEAVY, carry: tuple = ()) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts in a document with a smaller id.

    Texts are their UTF-8 bytes (null: empty); matches never cross documents and are judged on the input. Returns
    one row per input row: the id column, n_bytes, n_removed, kept (remaining bytes), kept_text (the text without
    the characters all of whose bytes go) and spans (maximal removed byte ranges, end exclusive). Ids are integers;
    a null id counts as larger than any other, rows with the same id are one document to each other (none removes
    from another). The columns named in ``carry`` come along unchanged, others are ignored; an empty table gives an
    empty result. Exact up to collisions of 128-bit cell hashes.
    """
    gram = min(gram, width)
    d, n_groups = X.deal_groups(docs, id_col, text_col, group_bytes, carry)
    d = d.withColumn("id", d["id"].cast("long"))
    more = [f"c{i}" for i in range(len(carry))]
    n = n_groups // 2 + 1  # buckets

    def group_of(table: pa.Table) -> int:
        return table.column("g")[0].as_py()

    def ask_cells(table: pa.Table) -> pa.Table:
        return X.ask_table(group_of(table), 1, _Cells(table, width).questions(), n)

    def segments_of(table: pa.Table, answers: pa.Table):
        cells = _Cells(table, width)
        starts, counts, hashes = cells.segments(cells.window_flags(~cells.covered_cells(answers, n)), gram)
        return cells, starts, counts, X.distinct(hashes)

    def ask_segments(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, _, ((keys,), _, counts) = segments_of(table, answers)
        return X.ask_table(group_of(table), 2, [keys, np.minimum(counts, 65535).astype(np.uint16)], n)

    def send_segments(table: pa.Table, answers: pa.Table) -> pa.Table:
        cells, starts, counts, ((keys,), place, _) = segments_of(table, answers)
        shared = X.answered(answers, 2, keys, n)[place]
        many = X.answered(answers, 3, keys, n)[place] & shared
        deal = keys[place]
        # strings of very common hashes, each distinct one once
        single, single_deal, gone, like = _distinct_strings(cells, TA.expand(starts[many], counts[many]), width)
        plain = shared & ~many
        starts = np.concatenate([starts[plain], single])
        counts = np.concatenate([counts[plain], np.ones(len(single), np.int64)])
        deal = np.concatenate([deal[plain], single_deal])
        order = np.argsort(deal, kind="stable")
        starts, counts, deal = starts[order], counts[order], deal[order]
        doc = np.searchsorted(cells.offs, starts, side="right") - 1
        ids = cells.ids[doc].astype(U) ^ SIGN
        refs = np.stack([doc, starts - cells.offs[doc], counts]).astype(np.int32)
        rows, buckets = [], []
        for b, lo, hi in zip(*(a.tolist() for a in X.bucket_slices(deal, n))) if len(deal) else ():
            text = cells.data[TA.expand(starts[lo:hi], counts[lo:hi] + width - 1)]
            rows.append(np.int64(hi - lo).tobytes() + ids[lo:hi].tobytes() + refs[:, lo:hi].tobytes() + text.tobytes())
            buckets.append(b)
        kinds = [4] * len(rows)
        for kind, runs in ((5, gone), (6, like)):
            if len(runs):
                rows.append(runs.tobytes())
                buckets.append(group_of(table) % n)
                kinds.append(kind)
        k = len(rows)
        return pa.table({"b": pa.array(buckets, pa.int64()), "g": pa.array(np.full(k, group_of(table), np.int64)),
                         "kind": pa.array(kinds, pa.int32()), "payload": pa.array(rows, pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        cells = _Cells(table, width)
        flags = cells.window_flags(cells.covered_cells(answers, n))
        kinds = answers.column("kind").to_numpy() if answers.num_rows else np.zeros(0)
        payload = answers.column("payload")
        for i in np.flatnonzero(kinds == 4).tolist():
            doc, start, length = np.frombuffer(payload[i].as_py(), np.int32).reshape(-1, 3).astype(np.int64).T
            flags[TA.expand(cells.offs[doc] + start, length)] = True
        for i in np.flatnonzero(kinds == 5).tolist():
            start, length = np.frombuffer(payload[i].as_py(), np.int64).reshape(-1, 2).T
            flags[TA.expand(start, length)] = True
        for i in np.flatnonzero(kinds == 6).tolist():  # copies of first copies, which kind 4 has answered
            origin, start, length = np.frombuffer(payload[i].as_py(), np.int64).reshape(-1, 3).T
            flags[TA.expand(start, length)] = flags[TA.expand(origin, length)]
        kept, texts, spans, n_removed = [], [], [], []
        for i, j, d, o in TA.blocks(cells.data, cells.offs, BLOCK_BYTES):
            gone = TA.covered(np.flatnonzero(flags[cells.offs[i]:cells.offs[j]]), width, len(d))
            whole = _whole_characters(d, gone)
            for lo, hi in zip(o[:-1].tolist(), o[1:].tolist()):
                x = gone[lo:hi]
                step = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(step[::2], step[1::2])])
                n_removed.append(int(np.count_nonzero(x)))
                kept.append(d[lo:hi][~x].tobytes())
                texts.append(d[lo:hi][~whole[lo:hi]].tobytes().decode("utf-8", "replace"))
        return pa.table({"id": cells.table.column("id"), "n_bytes": pa.array(np.diff(cells.offs), pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "kept": pa.array(kept, pa.binary()), "kept_text": pa.array(texts, pa.string()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         **{c: cells.table.column(c) for c in more}})

    def bucket_step(asked: DataFrame, answer) -> DataFrame:
        return asked.groupBy("b").applyInArrow(answer, X.ASK_SCHEMA)

    def group_step(answers: DataFrame, step, schema: str = X.ASK_SCHEMA) -> DataFrame:
        return d.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(step, schema)

    cells = bucket_step(d.groupBy("g").applyInArrow(ask_cells, X.ASK_SCHEMA), _smallest_id)
    counts = bucket_step(group_step(cells, ask_segments), _segment_counts(heavy))
    sorted_ = bucket_step(group_step(cells.unionByName(counts), send_segments), _sort_bucket(width, shallow))
    out = group_step(cells.unionByName(sorted_), finish,
                     "id long, n_bytes long, n_removed long, kept binary, kept_text string, "
                     "spans array<struct<start:long,end:long>>"
                     + "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in more))
    return out.withColumnsRenamed({"id": id_col, **dict(zip(more, carry))})
