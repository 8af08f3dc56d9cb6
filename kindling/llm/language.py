"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, each permuted
(rotated) by its place; a text is the sum of its trigrams' vectors, a language the sum over its training texts. A
document gets the language whose prototype has the largest cosine with its vector. Letters are Unicode letters in
lower case; a run of anything else is one boundary symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kindling.llm import exchange as X
from kindling.llm import textarrays as TA

DIMENSIONS = 1024
UNKNOWN = "und"
_COLUMNS = 4096  # trigrams multiplied at a time
_ROWS = 1024  # texts counted at a time: the counts are a table of texts x trigrams
_LANGUAGES = 4096  # sums of a task kept before they are handed on


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to its letter in lower case, 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(letters: np.ndarray, dims: int) -> np.ndarray:
    """(letters, dims) of +1 and -1, a fixed function of each letter."""
    bits = TA.mix(letters.astype(np.uint64)[:, None] * np.uint64(TA.BASE_A)
                  + np.arange(1, dims // 64 + 1, dtype=np.uint64)[None, :] * np.uint64(TA.BASE_B))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def trigram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """Bound vectors of trigrams given as three 21-bit letters."""
    parts = [(codes >> 42) & 0x1FFFFF, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]
    letters, at = np.unique(np.concatenate(parts), return_inverse=True)
    base, n = letter_vectors(letters, dims), len(codes)
    out = np.roll(base, 2, axis=1)[at[:n]]
    out *= np.roll(base, 1, axis=1)[at[n:2 * n]]
    out *= base[at[2 * n:]]
    return out


def trigrams(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of every trigram with a letter, over a block of documents."""
    chars = np.frombuffer(d.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
    if heads[-1] != len(chars):  # not UTF-8: decode one document at a time
        parts = [np.frombuffer(d[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                 for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
        chars, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    else:
        at = heads[o]
    n = np.diff(at)
    place = np.arange(len(chars)) + np.repeat(2 * np.arange(len(n)), n) + 1  # a boundary before and after each text
    x = np.zeros(len(chars) + 2 * len(n), dtype=np.int64)
    x[place] = _letters()[chars]
    doc = np.repeat(np.arange(len(n)), n + 2)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    inside = (doc[2:] == doc[:-2]) if len(x) > 2 else np.zeros(0, dtype=bool)
    return doc[2:][inside], ((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])[inside]


def bundles(owner: np.ndarray, codes: np.ndarray, n: int, dims: int) -> np.ndarray:
    """(n, dims): the sum of the vectors of the trigrams of each owner (integers, exact in float64 sums)."""
    out = np.zeros((n, dims))
    (u,), place, _ = X.distinct(codes)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for lo in range(0, len(u), _COLUMNS):
        hi = min(lo + _COLUMNS, len(u))
        a, b = np.searchsorted(place, [lo, hi])
        counts = np.bincount(owner[a:b] * (hi - lo) + place[a:b] - lo, minlength=n * (hi - lo)).reshape(n, hi - lo)
        out += counts.astype(np.float32) @ trigram_vectors(u[lo:hi], dims)
    return out


def fit_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   dims: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from every row of ``docs`` with a text and a language.

    Each task sums its texts; the sums meet by (language, dimension). What reaches the driver is one vector per
    distinct language.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            named = np.array(batch.column("lang").to_pylist(), dtype=object)
            data, offs = TA.string_block(batch.column("text"))
            for i, j, d, o in TA.blocks(data, offs, max_rows=_ROWS):
                langs, code = np.unique(named[i:j], return_inverse=True)
                doc, grams = trigrams(d, o)
                part = bundles(code[doc], grams, len(langs), dims)
                for k, lang in enumerate(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + part[k]
                if len(sums) >= _LANGUAGES:
                    yield handed(sums)
                    sums = {}
        if sums:
            yield handed(sums)

    def handed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(list(sums.values()))
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dims), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), v], names=["lang", "v"])

    d = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    rows = (d.mapInArrow(partial, "lang string, v array<double>").select("lang", F.posexplode("v").alias("dim", "x"))
            .groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect())
    langs = sorted({r.lang for r in rows})
    out = np.zeros((len(langs), dims))
    for r in rows:
        out[langs.index(r.lang), r.dim] = r.x
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text",
                     lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language of the largest cosine and that cosine (0 to 1; below 0 counts as 0).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned; ties
    go to the first language in order. Columns that already have the two names are replaced.
    """
    docs = docs.drop(lang_out, score_out)
    at, dims = docs.columns.index(text_col), prototypes.shape[1]
    names = np.array([*langs, UNKNOWN], dtype=object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = TA.string_block(batch.column(at))
            best, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            for i, j, d, o in TA.blocks(data, offs, max_rows=_ROWS) if langs else ():
                doc, grams = trigrams(d, o)
                v = bundles(doc, grams, j - i, dims)
                size = np.linalg.norm(v, axis=1)
                cos = v @ prototypes.T / np.maximum(size, 1e-12)[:, None]
                some = np.bincount(doc, minlength=j - i) > 0
                best[i:j] = np.where(some, cos.argmax(axis=1), len(langs))
                score[i:j] = np.where(some, np.clip(cos.max(axis=1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, lang_out, score_out])

    schema = StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])
    return docs.mapInArrow(predict, schema)
