"""Collocations against a brute-force count, and the counting quotient filters against plain sorting."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindling.llm import phrases as P
from kindling.llm import quotient as Q
from kindling.llm.phrases import mine_phrases
from kindling.llm.queries import QUERIES
from tests_paths import SF001

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count=10, percent=50, top=2000):
    """Dictionaries of all n-grams, one after the other."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i:i + k])] += 1
            n[lang or "und"] += len(words)
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            if len(p) == 2 and any(100 * f[q] >= percent * a for q in f if len(q) == 3 and f[q] >= min_count and p in (q[:2], q[1:])):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, phrase, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocab = ["Of", "of", "the", "a", "New", "York", "é", "x\x01", "x", "b" * 40, "-", "'", "İ"]
    rows = []
    for i in range(700):
        text = " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ",", "\n", "\x0b", " \t"]) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([None, "und", "en", "de"]), text))
    same = (1000, "en", "the very same page of words")
    return rows + [(800, "en", None), (801, None, None), (802, "en", ""), (803, "fr", "alone"), *[same] * 300,
                   (900, "de", "a long text. " * 5000), (901, "it", "nostop " * 4000)]


@pytest.mark.parametrize("setting", ["plain", "small"])
def test_phrases_equal_brute_force(spark, prose, setting, monkeypatch):
    if setting == "small":  # many shards and buckets, cut texts, few hot keys
        monkeypatch.setattr(P, "SHARD_BYTES", 500)
        monkeypatch.setattr(P, "BUCKET_KEYS", 4096)
        monkeypatch.setattr(P, "WORD_BUCKET_BYTES", 20_000)
        monkeypatch.setattr(P, "HOT", 6)
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in prose], "doc_id long, lang string, text string, n int, word string, a int")
    expected = brute([r[1:] for r in prose])
    assert rows_of(mine_phrases(df.repartition(3))) == expected and len(expected) > 50
    if setting == "plain":
        assert rows_of(mine_phrases(df, top=7)) == [r for r in expected if r[1] <= 7]
        assert mine_phrases(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("lang", "text").collect()
    assert rows_of(QUERIES["op12_phrases"](spark, SF001)) == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("size", [3, 9, 57, 63, 66, 96, 126])
def test_packing_and_permutation_are_invertible(size):
    rng = np.random.default_rng(size)
    ids = [rng.integers(0, 1 << size // 3, 3000, dtype=np.uint64) for _ in range(3)]
    key = Q.pack(ids, size)
    hi, lo = Q.permute(*key, size)
    assert all(int(h) < 1 << max(size - 64, 0) and int(x) < 1 << min(size, 64) for h, x in zip(hi, lo))
    back = Q.restore(hi, lo, size)
    assert all((x == y).all() for x, y in zip(back, key))
    assert all((x == y).all() for x, y in zip(Q.unpack(*back, size), ids))
    if size <= 9:  # a permutation: every key once
        every = np.arange(1 << size, dtype=np.uint64)
        assert sorted(Q.permute(every * np.uint64(0), every, size)[1].tolist()) == every.tolist()


@pytest.mark.parametrize("bits, size", [(0, 9), (1, 9), (3, 9), (0, 63), (5, 63), (0, 96), (5, 96), (2, 126)])
def test_filters_keep_every_key_and_count(bits, size):
    rng = np.random.default_rng(bits)
    total, per_bucket = Counter(), defaultdict(list)
    for _ in range(4):
        ids = [rng.integers(0, min(1 << size // 3, 12), 3000).astype(np.uint64) for _ in range(3)]
        hi, lo = Q.permute(*Q.pack(ids, size), size)
        lo[1000:2000] = lo[0]  # keys that share lo
        hi[-600:], lo[-600:] = hi[0], lo[0]  # a count beyond one byte
        total.update(zip(hi.tolist(), lo.tolist()))
        h, l, n = Q.count_keys(hi, lo)
        for b, i, j in zip(*(x.tolist() for x in Q.bucket_edges(l, bits, size))):
            raw = Q.write_filter(h[i:j], l[i:j], n[i:j], bits, size)
            assert all((x == y).all() for x, y in zip(Q.read_filter(raw, b, bits, size), (h[i:j], l[i:j], n[i:j])))
            per_bucket[b].append(raw)
    merged = Counter()
    for b, filters in per_bucket.items():
        h, l, n = Q.merge_filters(filters, b, bits, size)
        assert (np.diff(l.astype(object)) >= 0).all()
        merged.update(dict(zip(zip(h.tolist(), l.tolist()), n.tolist())))
    assert merged == total
