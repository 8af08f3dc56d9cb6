"""BPE encoding and decoding with word ends, after a public tokenizer file of the ``tokenizers`` library.

Texts are cut at ASCII white space, which the file's pattern drops and across which nothing is normalised or merged;
each distinct chunk of a block is normalised and split into words by the file's own rules, and each distinct word is
merged once. Merging uses contiguous rank arrays: a row holds the parts of one short word, boundary by boundary, and
beside them the rank of each pair of neighbours. The least rank (the leftmost of equals) is searched again and again,
its boundary is deleted, and the two ranks beside it are refreshed. Many words are merged side by side as rows of one
matrix. A word of more than ``SHORT`` bytes keeps its parts as a linked list with a heap of ranks instead, since
scanning would take time in the square of its length; the merges are the same.

Decoding joins the strings of the tokens by spaces, which is what the library does for a file without a decoder.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from kindling.llm import textarrays as TA
from kindling.llm.wordids import distinct_words

SHORT = 32  # bytes of a word that is merged in a row of the matrix
ROWS = 4096  # words merged side by side
BLOCK_BYTES = 1 << 21  # of texts whose distinct chunks are solved together
KNOWN_PAIRS = 1 << 16  # ranks that the merging of a long word remembers
_BLANK = re.compile("[^\\S ]|\u180e")  # white space other than the blank, in any version of Unicode
NO_RANK = np.iinfo(np.int32).max


@dataclass(frozen=True)
class WordBpe:
    """A vocabulary as arrays; its size is the size of the file, whatever the corpus."""

    rules: str  # the file without its vocabulary: normaliser and word pattern
    pattern: str  # the word pattern
    pair: np.ndarray  # left id << 32 | right id, ascending
    rank: np.ndarray  # of each pair
    merged: np.ndarray  # id by rank
    inner: np.ndarray  # id of each character that stands for a byte, inside a word
    last: np.ndarray  # the same at the end of a word
    special: tuple  # (text, id) of the strings that are tokens by themselves
    data: np.ndarray  # token strings end to end, each with a space behind it
    offs: np.ndarray


def load_word_bpe(file: str) -> WordBpe:
    """Read a tokenizer file (JSON). It must be a byte-level BPE with a word-end suffix, a pattern that drops white
    space, plain special tokens and no decoder, truncation or padding of its own; anything else is refused."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    added = spec.get("added_tokens") or []
    plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    odd = [k for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    kinds = [s["type"] for s in steps]
    if (model["type"] != "BPE" or odd or not plain or spec.get("decoder") or spec.get("post_processor")
            or not model.get("end_of_word_suffix") or kinds != ["Split", "ByteLevel"]
            or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or "Regex" not in steps[0]["pattern"] or steps[1]["add_prefix_space"]):
        raise ValueError(f"{file}: not a byte-level BPE with word ends")
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pair = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.uint64)
    merged = np.array([vocab[a + b] for a, b in merges], np.int32)
    order = np.argsort(pair, kind="stable")
    strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in added}
    raw = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
    inner, last = np.full(0x144, -1, np.int32), np.full(0x144, -1, np.int32)  # signs of bytes lie below U+0144
    for c in (c for c in vocab if len(c) == 1 and ord(c) < 0x144):
        inner[ord(c)], last[ord(c)] = vocab[c], vocab[c + end]
    rules = {k: v for k, v in spec.items() if k not in ("model", "added_tokens", "truncation", "padding")}
    rules["model"] = {"type": "BPE", "vocab": {}, "merges": []}
    return WordBpe(json.dumps(rules), steps[0]["pattern"]["Regex"], pair[order], order.astype(np.int32), merged, inner, last,
                   tuple((t["content"], t["id"]) for t in added),
                   np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def _ranks(v: WordBpe, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair of neighbours; ``NO_RANK`` if they do not merge or one of them is missing (-1)."""
    key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
    return np.where((v.pair[at] == key) & (left >= 0) & (right >= 0), v.rank[at], NO_RANK).astype(np.int32)


def merge_rows(v: WordBpe, parts: np.ndarray) -> np.ndarray:
    """Merge short words side by side: one row of parts each, padded with -1, and one row of the ranks between them.
    Returns the merged rows, padded likewise."""
    out = np.full_like(parts, -1)
    row = np.arange(len(parts))
    parts = np.pad(parts, ((0, 0), (0, 1)), constant_values=-1)  # the last column stays empty
    ranks = _ranks(v, parts[:, :-1], parts[:, 1:])
    while True:
        at = np.arange(len(row))
        k = ranks.argmin(axis=1)
        least = ranks[at, k]
        go = least != NO_RANK
        if not go.all():
            done = ~go
            out[row[done], :parts.shape[1] - 1] = parts[done, :-1]
            if not go.any():
                return out
            row, parts, ranks, k, least = row[go], parts[go], ranks[go], k[go], least[go]
            at = at[:len(row)]
        parts[at, k] = v.merged[least]
        # delete the boundary behind part k, and its rank: every row gets one column shorter
        col = np.arange(ranks.shape[1], dtype=np.int32)[None, :]
        place = k.astype(np.int32)[:, None]
        parts = np.where(col > place, parts[:, 1:], parts[:, :-1])
        if ranks.shape[1] == 1:
            out[row, 0] = parts[:, 0]
            return out
        ranks = np.where(col[:, :-1] >= place, ranks[:, 1:], ranks[:, :-1])
        # refresh the ranks beside the merged part
        inside = np.flatnonzero(k < ranks.shape[1])
        ranks[inside, k[inside]] = _ranks(v, parts[inside, k[inside]], parts[inside, k[inside] + 1])
        behind = np.flatnonzero(k > 0)
        ranks[behind, k[behind] - 1] = _ranks(v, parts[behind, k[behind] - 1], parts[behind, k[behind]])


def merge_long(v: WordBpe, word: list[int]) -> list[int]:
    """The same merges of one long word: a linked list of its parts and a heap of (rank, place, both parts)."""
    part = list(word)
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids = np.array(part, np.int32)
    first = _ranks(v, ids[:-1], ids[1:])
    at = np.flatnonzero(first != NO_RANK)
    heap = [(r, i, part[i], part[i + 1]) for r, i in zip(first[at].tolist(), at.tolist())]
    heapq.heapify(heap)
    known: dict = {}

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            key = (part[i], part[j])
            if key not in known:
                if len(known) > KNOWN_PAIRS:
                    known.clear()
                known[key] = int(_ranks(v, np.array(key[:1], np.int32), np.array(key[1:], np.int32))[0])
            if known[key] != NO_RANK:
                heapq.heappush(heap, (known[key], i, *key))

    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if part[i] == a else n
        if j >= n or part[j] != b:
            continue  # one of the two parts was merged since
        part[i], part[j] = int(v.merged[rank]), -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [p for p in part if p >= 0]


def merge_words(v: WordBpe, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words, end to end, and their offsets, from the ids of their bytes in the same form."""
    size = np.diff(offs)
    order = np.argsort(size, kind="stable")  # rows of a matrix have about the same length
    short = order[size[order] <= SHORT]
    done, count = [], np.zeros(len(size), np.int64)
    for lo in range(0, len(short), ROWS):
        some = short[lo:lo + ROWS]
        n, width = size[some], int(size[some[-1]])
        parts = np.full((len(some), width), -1, np.int32)
        parts[np.arange(width)[None, :] < n[:, None]] = ids[TA.expand(offs[some], n)]
        merged = merge_rows(v, parts)
        count[some] = (merged >= 0).sum(axis=1)
        done.append(merged[merged >= 0])
    for i in order[len(short):].tolist():
        done.append(np.array(merge_long(v, ids[offs[i]:offs[i + 1]].tolist()), np.int32))
        count[i] = len(done[-1])
    flat = np.concatenate(done) if done else np.zeros(0, np.int32)
    head = np.zeros(len(size), np.int64)
    head[order] = np.cumsum(count[order]) - count[order]
    return flat[TA.expand(head, count)], np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


class _Encoder:
    """One task's encoder, with the file's normaliser and word pattern."""

    def __init__(self, v: WordBpe):
        from tokenizers import Tokenizer

        rules = Tokenizer.from_str(v.rules)
        self.v = v
        self.normal = rules.normalizer.normalize_str if rules.normalizer else str
        self.split = rules.pre_tokenizer.pre_tokenize_str
        self.ascii = regex.compile(f"(?:{v.pattern})| ").findall  # printable ASCII stands for its own bytes
        self.special = dict(v.special)
        names = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _words(self, chunk: str) -> list:
        """The words of one chunk as strings, and the ids of special tokens between them."""
        out: list = []
        for piece in self.marks.split(chunk) if self.marks else [chunk]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += [w for w, _ in self.split(self.normal(piece))]
        return out

    def _split(self, chunks: list[str]) -> tuple[list, np.ndarray]:
        """Words of all chunks in order, and how many each chunk has.

        Chunks go through the file's rules as one text with blanks between them. Chunks with special tokens go one by
        one, and so do those near one that holds white space of its own (beyond ASCII)."""
        if not chunks:
            return [], np.zeros(0, np.int64)
        joined = " ".join(chunks)
        if not (_BLANK.search(joined) or self.marks and self.marks.search(joined)):
            normal = self.normal(joined)
            if joined.isascii() and joined.isprintable():  # the pattern itself, which also finds the blanks between the chunks
                found = self.ascii(normal)
                cut = np.array([i for i, w in enumerate(found) if w == " "], np.int64)
                ends = np.append(cut, len(found)) - np.arange(len(chunks))
                return [w for w in found if w != " "], np.diff(ends, prepend=0)
            ends = np.cumsum(np.fromiter(map(len, normal.split(" ")), np.int64, len(chunks)) + 1)
            found = self.split(normal)
            starts = np.fromiter((at for _, (at, _) in found), np.int64, len(found))
            return [w for w, _ in found], np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(chunks))
        if len(chunks) > 64:  # only the part that needs it goes one by one
            mid = len(chunks) // 2
            (a, n), (b, m) = self._split(chunks[:mid]), self._split(chunks[mid:])
            return a + b, np.concatenate([n, m])
        each = [self._words(c) for c in chunks]
        return [w for words in each for w in words], np.fromiter(map(len, each), np.int64, len(each))

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the chunks, end to end, and their offsets."""
        words, count = self._split(chunks)
        place: dict = {}
        at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        own = [w for w in place if isinstance(w, str)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        signs = np.frombuffer("".join(own).encode("utf-32-le"), "<u4")
        ids = self.v.inner[signs]
        ids[offs[1:] - 1] = self.v.last[signs[offs[1:] - 1]]
        flat, ends = merge_words(self.v, ids, offs)
        if len(own) < len(place):  # special tokens are words of one id
            kept = np.array([isinstance(w, str) for w in place])
            n = np.ones(len(place), np.int64)
            n[kept] = np.diff(ends)
            all_ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            both = np.empty(int(all_ends[-1]), np.int32)
            both[TA.expand(all_ends[:-1][kept], n[kept])] = flat
            both[all_ends[:-1][~kept]] = [w for w in place if not isinstance(w, str)]
            flat, ends = both, all_ends
        n = np.diff(ends)[at]
        to = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        return flat[TA.expand(ends[:-1][at], n)], to.astype(np.int64)

    def block(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, end to end, and the offsets of the texts in them."""
        s, e, at = TA.words(d, o)
        first, place = distinct_words(d, s, e)
        text = d.tobytes()
        chunks = [text[a:b].decode("utf-8", "replace") for a, b in zip(s[first].tolist(), e[first].tolist())]
        simple = np.array([c.isascii() and c.isprintable() for c in chunks], dtype=bool)
        size, head, ids = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), []
        for some in (np.flatnonzero(simple), np.flatnonzero(~simple)):
            flat, ends = self.chunks([chunks[i] for i in some.tolist()])
            size[some], head[some] = np.diff(ends), ends[:-1] + sum(map(len, ids))
            ids.append(flat)
        count = size[place]
        return np.concatenate(ids)[TA.expand(head[place], count)], np.concatenate([[0], np.cumsum(count)]).astype(np.int64)[at]


def decode_block(v: WordBpe, ids: np.ndarray, offs: np.ndarray) -> list[str]:
    """Token strings of each id sequence, joined by spaces. An id outside the vocabulary stands for nothing."""
    known = (ids >= 0) & (ids < len(v.offs) - 1)
    safe = np.where(known, ids, 0)
    size = np.where(known, np.diff(v.offs)[safe], 0)
    raw = v.data[TA.expand(v.offs[:-1][safe], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[offs].tolist()
    return [raw[a:b - 1 if b > a else b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def _schema(docs: DataFrame, *new: StructField) -> StructType:
    return StructType([*docs.schema.fields, *new])


def _encoded(shared, at: int, make):
    """A ``mapInArrow`` function that adds the columns ``make(ids, offsets, nulls)`` to blocks of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(shared.value)
        for batch in batches:
            data, offs = TA.string_block(batch.column(at))
            for i, j, d, o in TA.blocks(data, offs, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                names, columns = make(*encoder.block(d, o), part.column(at).is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])
    return run


def encode_words(docs: DataFrame, vocabulary: WordBpe, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text (array<int>; null for a null text, empty for an empty one).

    Special tokens written out in a text are those tokens; none are added. The vocabulary is broadcast (its size is
    that of its file). Rows stay where they are, repeated rows and all other columns too; a column named ``ids_col`` is
    replaced.
    """
    docs = docs.drop(ids_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(ids, ends, null):
        return [ids_col], [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null)]

    return docs.mapInArrow(_encoded(shared, docs.columns.index(text_col), make),
                           _schema(docs, StructField(ids_col, ArrayType(IntegerType()))))


def decode_words(encoded: DataFrame, vocabulary: WordBpe, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each id sequence: token strings joined by spaces, special tokens included (null for
    null). A column named ``out_col`` is replaced."""
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):  # bounds the memory of the decoded texts
                part = batch.slice(lo, 250)
                lists = part.column(at).fill_null(pa.array([[]], part.column(at).type)[0])
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
                texts = decode_block(shared.value, lists.flatten().fill_null(-1).to_numpy(), ends)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=part.column(at).is_null().to_numpy(
                    zero_copy_only=False))], names=[*part.schema.names, out_col])

    return encoded.mapInArrow(decode, _schema(encoded, StructField(out_col, StringType())))


def round_trip_words(docs: DataFrame, vocabulary: WordBpe, text_col: str = "text", packed_col: str = "ids_le",
                     out_col: str = "decoded") -> DataFrame:
    """Both in one pass over the texts: the ids packed as little-endian unsigned 32-bit integers (the layout of
    training shards) and the text decoded from them; both null for a null text. Columns of these names are replaced."""
    docs = docs.drop(packed_col, out_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(ids, ends, null):
        raw, cut = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        missing = null.to_numpy(zero_copy_only=False)
        return [packed_col, out_col], [
            pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary(), mask=missing),
            pa.array(decode_block(shared.value, ids, ends), pa.string(), mask=missing)]

    return docs.mapInArrow(_encoded(shared, docs.columns.index(text_col), make),
                           _schema(docs, StructField(packed_col, BinaryType()), StructField(out_col, StringType())))
