"""Quality classifier: Bradley-Terry pairwise ranking over document features.

Every labelled document of quality 1 is preferred to every one of quality 0. A linear score is learned from such
pairs by the logistic loss on feature differences; the decision threshold is the quantile of the training scores at
the share of label 0. Features are counted from whole texts, as numpy passes over Arrow buffers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm import exchange as X
from kindling.llm import textarrays as TA

FEATURES = ["log_words", "word_length", "upper", "digit", "marks", "bars", "bangs", "other_punct", "newline", "non_ascii",
            "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "long_words", "short_words"]
MAX_LABELLED = 50_000  # labelled documents that a fit reads at most (those with the smallest id hashes)
PAIRS_PER_DOC = 8


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = {"upper": _class(bytes(range(0x41, 0x5B))), "digit": _class(b"0123456789"), "marks": _class(b"#*$%&<>"),
            "bars": _class(b"|"), "bangs": _class(b"!?"), "other_punct": _class(b".,;:'\"()[]{}-_/\\+=@^`~"),
            "newline": _class(b"\n"), "non_ascii": _class(bytes(range(0xC0, 0x100)))}


def _largest_count(doc: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, doc, counts)
    return out


def features(texts) -> np.ndarray:
    """(documents, features) of a string column; a null or empty text has zeros throughout."""
    data, offs = TA.string_block(texts)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for i, j, d, o in TA.blocks(data, offs):
        n = j - i
        s, e, wo = TA.words(d, o)
        n_words, size = np.diff(wo), np.maximum(np.diff(o), 1)
        words = np.maximum(n_words, 1)
        col = dict.fromkeys(FEATURES)
        col["log_words"] = np.log1p(n_words)
        total = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        col["word_length"] = np.log1p(total(e - s, wo) / words)
        for name, table in _CLASSES.items():
            col[name] = total(table[d], o) / size
        col["long_words"], col["short_words"] = total(e - s > 15, wo) / words, total(e - s < 4, wo) / words
        h = TA.word_hashes(TA.LOWER[d], s, e)
        doc = np.repeat(np.arange(n), n_words)
        (u, _), _, counts = X.distinct(doc, h)
        col["distinct_words"] = np.bincount(u, minlength=n) / np.sqrt(words)
        col["top_word"] = _largest_count(u, counts, n) / words
        at = TA.windows(wo, 2)
        pair = TA.range_hash(TA.prefix_hash(h, TA.BASE_A), at, at + 2, TA.BASE_A)
        (u, _), _, counts = X.distinct(doc[at], pair)
        col["repeated_pairs"] = np.bincount(u, weights=np.where(counts > 1, counts, 0), minlength=n) / words
        newline = np.ones(256, dtype=bool)
        newline[:] = False
        newline[0x0A] = True
        ls, le, lo = TA.words(d, o, newline)
        lines = TA.word_hashes(d, ls, le)
        (u, _), _, counts = X.distinct(np.repeat(np.arange(n), np.diff(lo)), lines)
        col["repeated_lines"] = np.bincount(u, weights=counts - 1, minlength=n) / np.maximum(np.diff(lo), 1)
        out[i:j] = np.stack([col[f] for f in FEATURES], axis=1)
    return out


@dataclass(frozen=True)
class Ranker:
    """A fitted score: ``weights`` over standardised features; ``threshold`` is the score of the decision."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float  # the reported score at the threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(x) - self.threshold + np.log(self.cut / (1 - self.cut)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, cut: float, l2: float = 1e-3, steps: int = 30, seed: int = 7) -> Ranker:
    """Newton steps on the mean of log(1 + exp(-w(x_better - x_worse))) + l2 |w|^2 / 2 over preference pairs."""
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse = z[y == 1], z[y == 0]
    w = np.zeros(z.shape[1])
    if len(better) == 0 or len(worse) == 0:  # nothing to rank: every score is the cut
        return Ranker(mean, scale, w, 0.0, cut)
    rng = np.random.default_rng(seed)
    n = PAIRS_PER_DOC * max(len(worse), min(len(better), len(worse) * 4))
    diff = better[rng.integers(0, len(better), n)] - worse[rng.integers(0, len(worse), n)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # chance of the wrong order
        grad = l2 * w - diff.T @ p / n
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    return Ranker(mean, scale, w, float(np.quantile(raw, (y == 0).mean())), cut)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])


def fit_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality", label_id: str | None = None, cut: float = 0.3,
               max_labelled: int = MAX_LABELLED) -> Ranker:
    """Learn from the documents that ``labels`` names (label 0 or 1; others and nulls are left out).

    At most ``max_labelled`` label rows are used: those with the smallest hashes of their id. They are few enough to
    be broadcast, so only their documents are featurised, and their features (16 numbers each) are what reaches the
    driver. A document with several label rows counts once for each.
    """
    label_id = label_id or id_col
    some = (labels.select(labels[label_id].alias("id"), labels[label_col].cast("int").alias("y"))
            .where("id is not null and y in (0, 1)").orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled))
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    rows = (d.join(F.broadcast(some), "id").select("id", "y", "text")
            .mapInArrow(_sample_features, f"id {id_type}, y int, x array<double>").toArrow())
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy()
    order = np.lexsort((*x.T, y)) if len(x) else np.zeros(0, int)  # the same fit whatever order the rows came in
    return fit_pairs(x[order], y[order], cut)


def rank_quality(docs: DataFrame, model: Ranker, text_col: str = "text", score_col: str = "score",
                 predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1, higher is better) and predicted = 1 where it reaches the model's cut, else 0.

    Every row is scored, null and empty texts too (as texts without words). Columns that already have the two names
    are replaced.
    """
    docs = docs.drop(score_col, predicted_col)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), pa.array((s >= model.cut).astype(np.int32))],
                names=[*batch.schema.names, score_col, predicted_col])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())])
    return docs.mapInArrow(score, schema)
