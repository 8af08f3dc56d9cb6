"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary comes from a public SentencePiece model file; nothing is trained. Spaces become the whitespace marker,
one marker is put in front, and the piece sequence of the highest summed log score is found. A character that no piece
covers falls back to the byte pieces of its UTF-8 bytes. Decoding turns markers back into spaces; it is exact: a
literal U+2581 in a text is no marker, so it travels as bytes.

A vocabulary in which no piece has a marker after another character lets the best path of a text split before every
run of markers, and at characters that occur in no piece. Texts are cut there, and each distinct segment of a block is
solved once: all its matches come from walking the trie from every position at once, and the Viterbi recursion runs
over all segments of the block position by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from kindling.llm import exchange as X
from kindling.llm import textarrays as TA

MARKER = "▁"
SPACE = 0x20
SOLVE_BYTES = 1 << 18  # bytes of distinct segments solved at a time
UNKNOWN_PENALTY = 10.0  # of a byte-fallback character below the least piece score
_LENGTHS = np.where(np.arange(256) < 0x80, 1, np.where(np.arange(256) < 0xE0, 2, np.where(np.arange(256) < 0xF0, 3, 4)))


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as arrays: the double array (``base``, ``check``, ``piece`` of a node or -1), scores, bytes."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray
    data: np.ndarray
    offs: np.ndarray
    is_byte: np.ndarray
    inner: np.ndarray  # bytes that occur in some piece
    fallback: float


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double-array trie: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, v in zip(keys, values):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                value.append(-1)
            node = children[node][c]
        value[node] = v
    size = 258 * len(children) // 8 + 258 * 1024  # room for every large family at the end, holes are filled first
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    queue, low, top = [(0, 0)], 1, 257
    for node, at in queue:
        piece[at] = value[node]
        marks = sorted(children[node])
        if not marks:
            continue
        low = used.find(0, low)
        slot, b = low, -1
        for _ in range(64 if len(marks) <= 8 else 0):  # a small family tries the first holes
            if slot > marks[0] and not any(used[slot + c - marks[0]] for c in marks):
                b = slot - marks[0] - 1
                break
            slot = used.find(0, slot + 1)
        if b < 0:
            b = top - marks[0] - 1
        if b + 514 > len(used):
            more = len(used)
            used.extend(bytes(more))
            base, check, piece = (np.concatenate([x, np.full(more, f, np.int32)]) for x, f in ((base, 0), (check, -1), (piece, -1)))
        base[at] = b
        for c in marks:
            used[b + c + 1] = 1
            check[b + c + 1] = at
            queue.append((children[node][c], b + c + 1))
        top = max(top, b + marks[-1] + 2)
    return base[:top + 257], check[:top + 257], piece[:top + 257]


def load_pieces(model_file: str, log_scores: str = "zipf") -> Pieces:
    """Read a SentencePiece model with byte pieces.

    ``log_scores="stored"`` takes the file's scores as log probabilities (unigram models). The scores of a BPE model are
    merge ranks; ``"zipf"`` turns rank r into -log(r + 2), the log probability of Zipf's law but for a constant.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    stored = np.array([m.get_score(i) for i in range(n)])
    score = stored if log_scores == "stored" else -np.log(np.minimum(-stored, n) + 2)
    byte_ids, raw, keys, values = np.full(256, -1, np.int32), [], [], []
    is_byte = np.zeros(n, dtype=bool)
    for i in range(n):
        text = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            is_byte[i] = True
            raw.append(bytes([int(text[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            raw.append(b"")
        else:
            key = text.replace(MARKER, " ").encode()
            if b" " in key.lstrip(b" "):
                raise ValueError(f"piece {text!r} has a marker after another character")
            raw.append(key)
            keys.append(key)
            values.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    base, check, piece = double_array(keys, values)
    inner = np.zeros(256, dtype=bool)
    inner[list(set(b"".join(keys)))] = True
    return Pieces(base, check, piece, score, byte_ids, np.frombuffer(b"".join(raw), np.uint8),
                  np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), is_byte, inner,
                  float(score[values].min()) - UNKNOWN_PENALTY)


def _matches(v: Pieces, d: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every piece in ``d`` that stays before its position's entry of ``ends``."""
    at = np.flatnonzero((d & 0xC0) != 0x80)
    node, k, out = np.zeros(len(at), np.int64), 0, []
    while len(at):
        live = at + k < ends[at]
        at, node = at[live], node[live]
        nxt = v.base[node].astype(np.int64) + d[at + k] + 1
        ok = v.check[nxt] == node
        at, node = at[ok], nxt[ok]
        k += 1
        hit = v.piece[node] >= 0
        out.append((at[hit], at[hit] + k, v.piece[node[hit]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def solve(v: Pieces, d: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the best path of each segment, end to end, and their offsets; equal scores prefer the longer last piece."""
    n, seg_of = len(offs) - 1, np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start, end, piece = _matches(v, d, offs[1:][seg_of])
    # byte fallback of one character where no piece is that character
    heads = np.flatnonzero((d & 0xC0) != 0x80)
    tails = np.minimum(heads + _LENGTHS[d[heads]], offs[1:][seg_of[heads]])
    single = np.zeros(len(d), dtype=bool)
    one = end - start == _LENGTHS[d[start]]
    single[start[one]] = True
    bare = ~single[heads]
    start = np.concatenate([start, heads[bare]])
    end = np.concatenate([end, tails[bare]])
    piece = np.concatenate([piece, np.full(int(bare.sum()), -1, piece.dtype)])
    gain = np.where(piece >= 0, v.score[piece], v.fallback)
    seg = seg_of[start]
    place = end - offs[seg]  # Viterbi runs over the place of the end within its segment
    order = np.lexsort((start, seg, place))
    start, end, piece, gain, seg, place = (x[order] for x in (start, end, piece, gain, seg, place))
    best = np.full(len(d) + n + 1, -np.inf)  # best[e + segment]: score of the path that ends before byte e
    best[offs[:-1] + np.arange(n)] = 0
    back = np.zeros(len(d) + 1, np.int64)
    cut = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        total = best[start[lo:hi] + seg[lo:hi]] + gain[lo:hi]
        head = np.flatnonzero(np.diff(seg[lo:hi], prepend=-1))
        top = np.maximum.reduceat(total, head)
        size = np.diff(np.append(head, hi - lo))
        wins = np.flatnonzero(total == np.repeat(top, size))
        first = wins[np.searchsorted(wins, head)] + lo  # the smallest start among equals
        best[end[first] + seg[first]] = top
        back[end[first]] = first
    # walk back from the end of every segment at once
    at, live, steps = offs[1:].copy(), np.flatnonzero(np.diff(offs) > 0), []
    while len(live):
        edge = back[at[live]]
        steps.append((live, edge))
        at[live] = start[edge]
        live = live[at[live] > offs[live]]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    s, e = np.concatenate([x[0] for x in steps]), np.concatenate([x[1] for x in steps])
    order = np.lexsort((start[e], s))
    s, e = s[order], e[order]
    width = np.where(piece[e] >= 0, 1, end[e] - start[e])
    ids = np.repeat(piece[e], width)
    raw = TA.expand(np.where(piece[e] >= 0, 0, start[e]), width)
    ids = np.where(ids >= 0, ids, v.byte_ids[d[raw]]).astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum(np.bincount(s, weights=width, minlength=n))]).astype(np.int64)


def encode_block(v: Pieces, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block of texts, end to end, and the offsets of the texts in them. An empty text has no ids."""
    n = np.diff(o)
    some = (n > 0).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(n + some)]).astype(np.int64)
    x = np.full(int(offs[-1]), SPACE, np.uint8)  # the marker in front of each text
    x[np.arange(len(d)) + np.repeat(np.cumsum(some), n)] = d
    if len(x) == 0:
        return np.zeros(0, np.int32), offs
    space, odd = x == SPACE, ~v.inner[x]
    head = np.zeros(len(x), dtype=bool)
    head[1:] = (space[1:] & ~space[:-1]) | (odd[1:] != odd[:-1])
    head[offs[:-1][some > 0]] = True
    head &= (x & 0xC0) != 0x80
    s = np.flatnonzero(head)
    e = np.append(s[1:], len(x))
    p = TA.prefix_hash(TA.BYTE_VALUES[x], TA.BASE_BYTES)
    _, place, _ = X.distinct(TA.range_hash(p, s, e, TA.BASE_BYTES), (e - s).astype(np.uint64))
    _, sample = np.unique(place, return_index=True)
    size = (e - s)[sample]
    text, at = x[TA.expand(s[sample], size)], np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    solved = [solve(v, part, o) for _, _, part, o in TA.blocks(text, at, SOLVE_BYTES)]
    ids = np.concatenate([part for part, _ in solved])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in solved]))])
    count = np.diff(at)[place]
    flat = ids[TA.expand(at[:-1][place], count)]
    ends = np.concatenate([[0], np.cumsum(count)])
    return flat, ends[np.searchsorted(s, offs)]


def decode_block(v: Pieces, ids: np.ndarray, offs: np.ndarray) -> list[str]:
    """Texts of id sequences: piece bytes end to end, without the marker in front."""
    size = np.diff(v.offs)[ids]
    d = v.data[TA.expand(v.offs[:-1][ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[offs].tolist()
    raw = d.tobytes()
    # only a marker that came from a piece is taken off, not a byte piece that happens to be a space
    lead = np.zeros(len(offs) - 1, dtype=bool)
    some = np.flatnonzero(np.diff(offs) > 0)
    first = ids[offs[:-1][some]]
    lead[some] = ~v.is_byte[first] & (np.diff(v.offs)[first] > 0) & (v.data[np.minimum(v.offs[:-1][first], len(v.data) - 1)] == SPACE)
    return [raw[a + k:b].decode("utf-8", "replace") for a, b, k in zip(ends[:-1], ends[1:], lead.tolist())]


def _with(docs: DataFrame, *new: StructField) -> StructType:
    return StructType([*docs.schema.fields, *new])


def _id_lists(v: Pieces, d: np.ndarray, o: np.ndarray, null: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids, ends = encode_block(v, d, o)
    return ids, ends, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null)


def _texts(v: Pieces, ids: np.ndarray, ends: np.ndarray, null: pa.Array) -> list[pa.Array]:
    """Decoded texts and the number of byte pieces of each sequence."""
    missing = null.to_numpy(zero_copy_only=False).tolist()
    texts = [None if x else t for t, x in zip(decode_block(v, ids, ends), missing)]
    return [pa.array(texts, pa.string()), pa.array(np.diff(np.concatenate([[0], np.cumsum(v.is_byte[ids])])[ends]), pa.int64())]


def encode_pieces(docs: DataFrame, vocabulary: Pieces, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text (array<int>; null for a null text, empty for an empty one).

    The vocabulary (a few MB, whatever the corpus) is broadcast. A column named ``ids_col`` is replaced.
    """
    docs = docs.drop(ids_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = TA.string_block(batch.column(at))
            for i, j, d, o in TA.blocks(data, offs):
                part = batch.slice(i, j - i)
                _, _, lists = _id_lists(shared.value, d, o, part.column(at).is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, ids_col])

    return docs.mapInArrow(encode, _with(docs, StructField(ids_col, ArrayType(IntegerType()))))


def decode_pieces(encoded: DataFrame, vocabulary: Pieces, ids_col: str = "ids", out_col: str = "decoded",
                  bytes_col: str = "n_byte_pieces") -> DataFrame:
    """``encoded`` with the text of each id sequence (null for null) and how many of its pieces are bytes.

    Control and unknown ids stand for nothing. Columns that already have the two names are replaced.
    """
    encoded = encoded.drop(out_col, bytes_col)
    at = encoded.columns.index(ids_col)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):  # bounds the memory of the decoded texts
                part = batch.slice(lo, 250)
                null = part.column(at).is_null()
                lists = part.column(at).fill_null(pa.array([[]], part.column(at).type)[0])
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *_texts(shared.value, lists.flatten().to_numpy(), ends, null)],
                    names=[*part.schema.names, out_col, bytes_col])

    return encoded.mapInArrow(decode, _with(encoded, StructField(out_col, StringType()), StructField(bytes_col, LongType())))


def round_trip_pieces(docs: DataFrame, vocabulary: Pieces, text_col: str = "text", ids_col: str = "ids",
                      out_col: str = "decoded", bytes_col: str = "n_byte_pieces") -> DataFrame:
    """Both of the above in one pass over the texts: ids, the text decoded from them, the number of byte pieces."""
    docs = docs.drop(ids_col, out_col, bytes_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = TA.string_block(batch.column(at))
            for i, j, d, o in TA.blocks(data, offs):
                part = batch.slice(i, j - i)
                null = part.column(at).is_null()
                ids, ends, lists = _id_lists(shared.value, d, o, null)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *_texts(shared.value, ids, ends, null)],
                                                 names=[*part.schema.names, ids_col, out_col, bytes_col])

    return docs.mapInArrow(both, _with(docs, StructField(ids_col, ArrayType(IntegerType())),
                                       StructField(out_col, StringType()), StructField(bytes_col, LongType())))
