import importlib
import re

from test_dedup import brute_near, brute_suffix
from test_native import ITEM_WORD, ASCII_LOWER
from tests_paths import SF001

import corpus_pipeline as P
from kindling.llm.queries import QUERIES


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup",
                                        "benchmark_decontamination", "sentencepiece"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    good = P.quality_stage(spark, docs, SF001)
    assert good.columns == list(P.COLUMNS) and 0 < good.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]

    unique = P.near_duplicate_stage(spark, good, SF001)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, _, _, kept in brute_near(rows) if kept)

    cut = P.suffix_stage(spark, unique, SF001)
    assert cut.columns == list(P.COLUMNS)
    expected = {i: kept for i, _, _, kept in brute_suffix([(r.doc_id, r.text) for r in unique.collect()], 50)}
    for r in cut.collect():
        assert r.n_chars == len(r.text)
        assert len(r.text.encode()) - len(expected[r.doc_id]) <= 12  # characters cut in the middle stay whole
        if r.text.isascii():
            assert r.text.encode() == expected[r.doc_id]

    clean = P.decontamination_stage(spark, cut, SF001)
    words = lambda t: ITEM_WORD.findall((t or "").translate(ASCII_LOWER))
    windows = set()
    for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k:k + 13]) for k in range(len(w) - 12)}
    dropped = {r.doc_id for r in cut.collect()} - {r.doc_id for r in clean.collect()}
    for r in cut.collect():
        w = words(r.text)
        hit = {k + a for k in range(len(w) - 12) if tuple(w[k:k + 13]) in windows for a in range(13)}
        assert (r.doc_id in dropped) == (len(hit) > 0 and 20 * len(hit) >= len(w))

    out = P.sentencepiece_stage(spark, clean, SF001).collect()
    assert len(out) == clean.count() and all(r.round_trip for r in out)


def test_stages_take_nulls_and_empty_tables(spark, docs, empty):
    for table in (docs, empty):
        for name, stage in P.STAGES:
            out = stage(spark, table, SF001)
            if name != "sentencepiece":
                assert out.columns == list(P.COLUMNS)
            assert out.count() <= table.count()


def test_rows_with_repeated_and_null_ids_are_judged_one_by_one(spark):
    say = lambda name, n=80: " ".join(f"{name}{k}" for k in range(n))
    near = lambda name: say(name) + " tail"
    rows = [(1, say("a")), (2, say("b")), (2, near("a")), (3, say("c")), (3, say("c")), (4, say("d")), (None, near("d")),
            (None, say("e")), (None, say("e")), (5, say("f")), (5, near("f")), (None, None), (None, None), (6, "")]
    table = lambda r: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in r],
                                            "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_duplicate_stage(spark, table(rows), SF001).collect()]
    fixed = [(1, say("a")), (2, say("b")), (3, say("c")), (4, say("d")), (None, say("e")), (None, None), (6, "")]
    assert sorted(map(repr, (r for r in got if r[0] != 5))) == sorted(map(repr, fixed))
    assert len([r for r in got if r[0] == 5]) == 1

    passage = max((r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect() if r.text), key=len)
    rows = [(1, say("a")), (1, passage), (None, passage), (None, say("b")), (2, passage)]
    got = [(r.doc_id, r.text) for r in P.decontamination_stage(spark, table(rows), SF001).collect()]
    assert sorted(got, key=repr) == sorted([(1, say("a")), (None, say("b"))], key=repr)


def test_entry_registers_every_operator():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= names
