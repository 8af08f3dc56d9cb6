"""BPE with word ends against the library that the vocabulary file belongs to."""
import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from kindling.llm import word_bpe as W
from kindling.llm.queries import QUERIES
from kindling.llm.word_bpe import decode_words, encode_words, load_word_bpe, round_trip_words
from tests_paths import SF001

FILE = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return load_word_bpe(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def hard_texts():
    rng = random.Random(4)
    alphabet = "abcdefgh's'tTHEé ßİΣΑς你𓀀🙂̈́\x85  \x1c\x0b\x00 \n.,!?0123٣½ŁǅK'LL'D<|>"
    texts = ["", " ", "Hello World <|endoftext|>x<|startoftext|> it's'll 12345", "ΑΣ", "a" * 3000, "<|endoftext|><|endoftext|>",
             "̈a é", "y" * 33, "Ab" * 16, "é" * 40, "internationalization " * 3, " ", "ab" * 700 + " cd"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return texts + ["<|endoftext|>".join("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(3))
                    for _ in range(60)]


@pytest.mark.parametrize("short", [32, 3])  # 3: nearly all words take the heap
def test_blocks_equal_the_library(vocabulary, library, short, monkeypatch):
    monkeypatch.setattr(W, "SHORT", short)
    texts = hard_texts()
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    ids, ends = W._Encoder(vocabulary).block(np.frombuffer(b"".join(raw), np.uint8), offs)
    back = W.decode_block(vocabulary, ids, ends)
    for t, a, b, text in zip(texts, ends[:-1], ends[1:], back):
        expected = library.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == expected, t
        assert text == library.decode(expected, skip_special_tokens=False)


def test_rows_nulls_and_clashing_columns(docs, corpus, empty, vocabulary, library):
    clash = docs.withColumn("ids", docs.doc_id)
    rows = decode_words(encode_words(clash, vocabulary), vocabulary).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        expected = None if r.text is None else library.encode(r.text, add_special_tokens=False).ids
        assert r.ids == expected and r.key is None and r.score == "clash"
        assert r.decoded == (None if expected is None else library.decode(expected, skip_special_tokens=False))
    packed = round_trip_words(docs, vocabulary).collect()
    same = sorted((repr(r.text), None if r.ids is None else np.array(r.ids, "<u4").tobytes(), r.decoded) for r in rows if r.text)
    assert same == sorted((repr(r.text), bytes(r.ids_le), r.decoded) for r in packed if r.text)
    assert encode_words(empty, vocabulary).collect() == round_trip_words(empty, vocabulary).collect() == []


def test_ids_outside_the_vocabulary_stand_for_nothing(spark, vocabulary):
    df = spark.createDataFrame([([320, 10 ** 6, -5, 320],), ([],), (None,), ([None, 320],)], "ids array<int>")
    word = vocabulary.data[vocabulary.offs[320]:vocabulary.offs[321]].tobytes().decode().strip()
    assert [r.decoded for r in decode_words(df, vocabulary).collect()] == [f"{word} {word}", "", None, word]


def test_query_equals_the_library_on_every_document(spark, library):
    got = {r.doc_id: r for r in QUERIES["op11_bpe"](spark, SF001).collect()}
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out = got[r.doc_id]
        assert out.n_tokens == len(ids) and out.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        load_word_bpe(path("byte_bpe_50k.json"))
