import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindling.llm import language as L
from kindling.llm import textarrays as TA
from kindling.llm.language import _ROWS, bundles, fit_prototypes, predict_language, trigrams
from kindling.llm.pieces import decode_pieces, encode_block, encode_pieces, load_pieces, round_trip_pieces
from kindling.llm.quality import fit_pairs, fit_ranker, rank_quality
from kindling.llm.queries import PIECE_MODEL, QUERIES
from tests_paths import SF001


@pytest.fixture(scope="module")
def vocabulary():
    return load_pieces(PIECE_MODEL)


def best_score(v, text):
    """Brute-force Viterbi over characters: the best score of any segmentation."""
    table = {v.data[a:b].tobytes(): i for i, (a, b) in enumerate(zip(v.offs[:-1].tolist(), v.offs[1:].tolist()))
             if b > a and not v.is_byte[i]}
    chars = [c.encode() for c in " " + text]
    best = [0.0] + [-np.inf] * len(chars)
    for e in range(1, len(chars) + 1):
        for s in range(max(0, e - 20), e):
            key = b"".join(chars[s:e])
            gain = v.score[table[key]] if key in table else (v.fallback if e - s == 1 else -np.inf)
            best[e] = max(best[e], best[s] + gain)
    return best[-1]


def path_score(v, ids):
    """Score of an id sequence; a run of byte pieces is its characters in fallback."""
    total, raw = 0.0, b""
    for i in ids:
        if v.is_byte[i]:
            raw += v.data[v.offs[i]:v.offs[i + 1]].tobytes()
        else:
            total += v.score[i]
    return total + v.fallback * len(raw.decode())


def test_viterbi_finds_the_best_path(vocabulary):
    rng = random.Random(2)
    texts = ["", " ", "  a", "Hello  world\n\tfoo ▁ x 你𓀀", "characteristics", "trail ", "▁▁"]
    texts += ["".join(rng.choice("ab the ▁é\n你𓀀=") for _ in range(rng.randint(1, 50))) for _ in range(80)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    ids, ends = encode_block(vocabulary, np.frombuffer(b"".join(raw), np.uint8), offs)
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        got = ids[a:b].tolist()
        assert (got == []) == (t == "")
        if t:
            assert path_score(vocabulary, got) == pytest.approx(best_score(vocabulary, t), abs=1e-6)


def test_round_trip_of_any_text(docs, corpus, empty, vocabulary):
    out = decode_pieces(encode_pieces(docs, vocabulary), vocabulary)
    rows = out.collect()
    assert len(rows) == len(corpus) and all(r.decoded == r.text for r in rows)
    assert all(r.ids is None for r in rows if r.text is None) and all(r.ids == [] for r in rows if r.text == "")
    again = round_trip_pieces(docs, vocabulary).collect()
    same = lambda rs: sorted((repr(r.doc_id), repr(r.text), r.ids or [], r.n_byte_pieces) for r in rs)
    assert same(rows) == same(again)
    assert encode_pieces(empty, vocabulary).collect() == [] and "key" in again[0].asDict()


def test_language_edges_and_clashing_columns(docs, empty):
    train = docs.where("doc_id < 60")
    langs, prototypes = fit_prototypes(train)
    assert langs == ["de", "en"]
    rows = predict_language(docs, langs, prototypes).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.text in (None, "", " \t\n")} == {"und"}
    assert predict_language(empty, langs, prototypes).collect() == []
    none, nothing = fit_prototypes(empty)
    assert {r.lang_pred for r in predict_language(docs, none, nothing).collect()} == {"und"}


def test_language_memory_is_bounded_on_many_short_texts():
    """The counts of texts by trigrams are made for a bounded number of texts, and blocks change no sum."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(45)) for _ in range(3000)]
    data, offs = TA.string_block(pa.array(texts))
    whole = bundles(*trigrams(data, offs), 3000, 256)
    tracemalloc.start()
    parts = []
    for i, j, d, o in TA.blocks(data, offs, max_rows=_ROWS):
        assert j - i <= _ROWS
        parts.append(bundles(*trigrams(d, o), j - i, 256))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(parts), whole) and peak < 150e6


def test_language_learns_many_labels_in_parts(spark, monkeypatch):
    """Sums are handed on when many labels gather; the prototypes stay those of all rows."""
    rows = [(f"l{i % 5}", f"text {i % 5} {'abcde'[i % 5] * 9}") for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    langs, p = fit_prototypes(df, dims=128)
    monkeypatch.setattr(L, "_LANGUAGES", 2)
    monkeypatch.setattr(L, "_ROWS", 3)
    again, q = fit_prototypes(df, dims=128)
    assert langs == again == [f"l{i}" for i in range(5)] and np.allclose(p, q, atol=1e-12)


def test_language_held_out_accuracy(spark):
    out = QUERIES["op3_language_id"](spark, SF001)
    truth = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang")
    rows = out.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_ranking_learns_order_and_quantile():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=400) > -0.8).astype(int)
    model = fit_pairs(x, y, cut=0.3)
    score = model.score(x)
    assert score[y == 1].mean() > 0.8 > 0.2 > score[y == 0].mean()
    assert (score < 0.3).mean() == pytest.approx((y == 0).mean(), abs=0.01)


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)] + [(1, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = fit_ranker(docs, labels)
    rows = rank_quality(docs, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows) and len(rows) == docs.count()
    assert rank_quality(empty, model).collect() == []
    blank = fit_ranker(docs, labels.where("quality = 1"))  # nothing to rank
    assert {r.predicted for r in rank_quality(docs, blank).collect()} == {1}


def test_quality_held_out_accuracy(spark):
    out = QUERIES["op8_quality"](spark, SF001)
    truth = spark.read.parquet(f"{SF001}/labels.parquet")
    rows = out.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 10 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert out.where(F.col("predicted") != (F.col("score") >= 0.3).cast("int")).count() == 0
