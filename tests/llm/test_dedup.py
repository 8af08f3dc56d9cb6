import collections
import re
import uuid

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kindling.llm import suffix_dedup as S
from kindling.llm.components import connected_components
from kindling.llm.minhash import _meeting, near_duplicates, signatures
from kindling.llm.substring import COVERS, substring_dedup
from kindling.llm.suffix_dedup import suffix_dedup
from kindling.llm.suffixes import order_suffixes

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_substring(rows, width):
    tokens = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(t[i:i + width]) for t in tokens for i in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, tokens):
        gone = set()
        for k in range(len(t) - width + 1):
            if seen[tuple(t[k:k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(t), len(gone), " ".join(w for k, w in enumerate(t) if k not in gone)))
    return out


def brute_suffix(rows, width):
    big = 1 << 62
    rows = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in rows:
        for k in range(len(t) - width + 1):
            w = t[k:k + width]
            least[w] = min(least.get(w, big + 1), big if i is None else i)
    out = []
    for i, t in rows:
        gone = set()
        for k in range(len(t) - width + 1):
            if least[t[k:k + width]] < (big if i is None else i):
                gone.update(range(k, k + width))
        out.append((i, len(t), len(gone), bytes(b for k, b in enumerate(t) if k not in gone)))
    return out


def brute_near(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets[k] = {tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    usable = [k for k in sets if rows[k][0] is not None and sets[k]]
    for a in usable:
        for b in usable:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = collections.defaultdict(lambda: 1 << 62)
    for k in usable:
        least[find(k)] = min(least[find(k)], rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)] if k in usable else i
        out.append((i, len(sets[k]), c, i is None or i == c))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_substring_equals_brute_force_over_many_groups(docs, corpus):
    pairs = [(r[0], r[1]) for r in corpus]
    for width, size in ((35, 4096), (35, 1 << 30), (5, 8192), (1, 8192)):
        got = substring_dedup(docs, width=width, group_bytes=size).drop("spans").collect()
        assert key(map(tuple, got)) == key(brute_substring(pairs, width))


def test_substring_spans_cover_what_is_removed(docs):
    for r in substring_dedup(docs, group_bytes=4096).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_covers_reach_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_suffix_equals_brute_force_over_many_groups(docs, corpus):
    pairs = [(r[0], r[1]) for r in corpus]
    for width, size, heavy in ((50, 4096, 20000), (50, 4096, 2), (50, 1 << 30, 20000), (12, 8192, 50), (3, 1 << 30, 20000)):
        got = suffix_dedup(docs, width=width, group_bytes=size, heavy=heavy, carry=("key", "g"))
        assert got.columns == ["doc_id", "n_bytes", "n_removed", "kept", "kept_text", "spans", "key", "g"]
        rows = got.collect()
        assert key((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows) == key(brute_suffix(pairs, width))
        for r in rows:
            assert r.g == 7 and sum(s.end - s.start for s in r.spans) == r.n_removed
            assert "\ufffd" not in r.kept_text


def test_a_group_sends_each_common_string_once(spark, tmp_path, monkeypatch):
    """One passage at different places of all documents, twice in some, some ids null or repeated."""
    rng, real = np.random.default_rng(8), S._sort_bucket
    say = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = say(70)
    rows = [(None if i % 40 == 7 else i // 2 if i % 10 == 3 else i, say(rng.integers(1, 90)) + passage + say(rng.integers(1, 90))
             + passage * (i % 3 == 0)) for i in range(200)]

    def sort_and_count(width, shallow):
        sort = real(width, shallow)

        def step(table):
            sent = collections.Counter()
            for g, kind, payload in zip(*(table.column(c).to_pylist() for c in ("g", "kind", "payload"))):
                if kind != 4:
                    continue
                n = int(np.frombuffer(payload, np.int64, 1)[0])
                at = 8 + 20 * n
                for count in np.frombuffer(payload, np.int32, n, 8 + 16 * n).tolist():
                    if count == 1:
                        sent[g, payload[at:at + width]] += 1
                    at += count + width - 1
            (tmp_path / uuid.uuid4().hex).write_text(str(max(sent.values(), default=0)))
            return sort(table)
        return step

    monkeypatch.setattr(S, "_sort_bucket", sort_and_count)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup(docs, group_bytes=8192, heavy=2).collect()
    assert key((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == key(brute_suffix(rows, 50))
    assert {int(f.read_text()) for f in tmp_path.iterdir()} == {1}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=60, max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.sampled_from([8, 16, 40]))
def test_deep_shallow_order(text, shallow):
    data, width = np.frombuffer(text, np.uint8), 50
    at = np.arange(len(text) - width + 1)
    order, head = order_suffixes(data, at, width, shallow)
    keys = [text[i:i + width] for i in order.tolist()]
    assert keys == sorted(text[i:i + width] for i in at.tolist())
    assert head.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]


def test_near_duplicates_equal_brute_force(docs, corpus):
    expected = key(brute_near([(r[0], r[1]) for r in corpus]))
    for block in (1024, 2):
        assert key(map(tuple, near_duplicates(docs, block=block).collect())) == expected


def test_star_alone_would_lose_links(spark):
    """A chain of shifted texts: neighbours are linked, the centre of a bucket is not linked with its far members."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[10 * k:10 * k + 100])) for k in range(20)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {min(r[0] for r in rows)}


def test_rare_shingles_meet_for_every_similar_pair(spark):
    """Mutated texts of many lengths on both sides of the threshold, each its own component: no similar pair is lost."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(90):
        w = base[:int(rng.integers(60, 150))]
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = f"x{int(rng.integers(12))}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[a:a + 5]) for a in range(len(w) - 4)} for w in (t.split(" ") for _, t in rows)]
    texts = spark.createDataFrame(rows, "id long, text string")
    alone = texts.selectExpr("id", "id as comp")
    for percent in (50, 75, 90):
        similar = {(a, b) for a in range(90) for b in range(a + 1, 90)
                   if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        met = {(r.a, r.b) for r in _meeting(texts, alone, 5, percent, 4).collect()}
        assert similar and similar <= met and len(met) < 90 * 89 / 2


def test_pages_of_one_template_under_the_threshold_do_not_meet(spark):
    """All share their buckets; their own words are the rarest shingles, so the work does not grow with the pairs."""
    template = " ".join(f"t{k}" for k in range(200))
    rows = [(i, template + " " + " ".join(f"p{i}_{k}" for k in range(40))) for i in range(600)]  # similarity 0.71
    rows.append((1000, template + " " + " ".join(f"p300_{k}" for k in range(30))))  # 0.96 with page 300, 0.74 with the others
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alone = docs.selectExpr("doc_id as id", "doc_id as comp")
    met = _meeting(docs.withColumnRenamed("doc_id", "id"), alone, 5, 75, 256).collect()
    assert [(r.a, r.b) for r in met] == [(300, 1000)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {i: 300 if i == 1000 else i for i in got}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for shared in (30, 150, 270, 300):
        other = np.concatenate([base[:shared], rng.integers(0, 1 << 63, 300 - shared, dtype=np.uint64)])
        sig = signatures(np.concatenate([np.sort(base), np.sort(other)]), np.array([0, 300, 600]), 2048)
        assert abs((sig[0] == sig[1]).mean() - shared / (600 - shared)) < 0.08
    one = signatures(np.array([5, 5], dtype=np.uint64), np.array([0, 1, 2]), 64)
    assert (one[0] == one[1]).all() and len(set(one[0].tolist())) == 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (50, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_empty_tables(empty):
    assert substring_dedup(empty).collect() == []
    assert suffix_dedup(empty).collect() == []
    assert near_duplicates(empty).collect() == []


def test_suffixes_that_agree_are_not_sorted_again(monkeypatch):
    text = np.frombuffer(b"the quick brown fox jumps over the lazy dog and then again it sleeps" * 40, np.uint8)
    at = np.arange(0, len(text) - 68, 68)
    monkeypatch.setattr(np, "lexsort", lambda *a, **k: (_ for _ in ()).throw(AssertionError("groups of one key were sorted")))
    order, head = order_suffixes(text, at, 50)
    assert sorted(order.tolist()) == list(range(len(at))) and head.tolist() == [True] + [False] * (len(at) - 1)


def test_distinct_tuples_with_first_hashes_equal_by_chance():
    from kindling.llm import exchange as X

    rng = np.random.default_rng(5)
    for n_first in (3, 1 << 60):
        a, b = rng.integers(0, n_first, 500).astype(np.uint64), rng.integers(0, 4, 500).astype(np.uint64)
        a, b = np.append(a, a[:100]), np.append(b, b[:100])
        plain, quick = X.distinct(a, b), X.distinct(a, b, hashed=True)
        assert all((x == y).all() for x, y in zip([*plain[0], *plain[1:]], [*quick[0], *quick[1:]]))
