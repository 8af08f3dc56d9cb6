"""Phrase collocation mining: exact n-gram counts in counting quotient filters, scores by the weakest cut.

How the data moves, with ``documents`` read once:

1. Each task cuts its texts into *shards* of a few MB. A shard becomes a stream of local word ids (0 between pieces)
   and its dictionary: one row per language and *word bucket* with the words and their counts. Both are written once.
2. A word bucket, dealt by the hash of language and word, adds up its words. A phrase of count c needs words of count c
   or more, so only words that reach ``min_count`` get an id; the others end a piece. No candidate and none of its parts is lost.
   The ids go back to the shards, one row per shard and bucket.
3. A shard counts its packed bigrams and trigrams and sends one filter per key bucket: a pair that every text holds is
   one key per shard.
4. A key bucket merges its filters and keeps the keys that reach ``min_count``. Buckets are dealt by hash or permuted
   key, so they are even whatever the words; their number grows with the corpus and their size does not.
5. Counts of the parts are joined to the candidates. A word or pair may be part of a third of all candidates: the
   at most ``HOT`` keys with more than 1 / ``HOT`` of all occurrences are broadcast, and only the others are joined by shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindling.llm import quotient as Q
from kindling.llm import textarrays as TA
from kindling.llm.wordids import distinct_words
from kindling.session import cut_lineage

U = np.uint64
SHARD_BYTES = 4 << 20  # text of a shard
WORD_BUCKET_BYTES = 16 << 20  # text of the corpus per word bucket; the dictionaries are smaller than the text
BUCKET_KEYS = 1 << 20  # n-grams of the corpus per key bucket, before equal ones are counted together
HOT = 10_000  # a key with more than 1 / HOT of all occurrences is hot; there are at most HOT of them
UNKNOWN = "und"

PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = PIECE_END.copy()
BETWEEN[[0x20, 0x09]] = True

_SHARDS = "shard long, bucket int, lang string, payload binary"  # bucket -1: the stream
_WORDS = "shard long, payload binary, id long, lang string, word string, f long"


def _cut_long(data: np.ndarray, offs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that also cut texts of more than ``limit`` bytes, at ends of pieces, and the text of each part."""
    long = np.flatnonzero(np.diff(offs) > limit)
    if len(long) == 0:
        return offs, np.arange(len(offs) - 1)
    more = []
    for i in long.tolist():
        ends = np.flatnonzero(PIECE_END[data[offs[i]:offs[i + 1]]]) + offs[i]
        want = np.arange(offs[i] + limit, offs[i + 1], limit)
        more.append(ends[np.minimum(np.searchsorted(ends, want), len(ends) - 1)] if len(ends) else ends)
    cuts = np.unique(np.concatenate(more))
    cuts = cuts[~np.isin(cuts, offs)]
    text_of = np.searchsorted(offs, cuts, side="right") - 1
    order = np.argsort(np.concatenate([offs[:-1], cuts]), kind="stable")
    return (np.append(np.concatenate([offs[:-1], cuts])[order], offs[-1]),
            np.concatenate([np.arange(len(offs) - 1), text_of])[order])


def shard_words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block of lower-cased texts: its stream (local id + 1 of each word, 0 between pieces), and start, end, kind and
    count of each distinct word. ``kind`` numbers the language of each text."""
    s, e, at = TA.words(data, offs, BETWEEN)
    of = np.repeat(kind, np.diff(at))
    first, place = distinct_words(data, s, e, of)
    stops = np.concatenate([[0], np.cumsum(PIECE_END[data])])
    cut = np.zeros(len(s), np.int64)
    cut[1:] = stops[s[1:]] != stops[e[:-1]]
    cut[at[:-1][np.diff(at) > 0]] = 1  # a text starts a piece
    stream = np.zeros(len(s) + int(cut.sum()), np.uint32)
    stream[np.arange(len(s)) + np.cumsum(cut)] = place + 1
    return stream, s[first], e[first], of[first], np.bincount(place, minlength=len(first))


def _dictionary(data: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray, local: np.ndarray) -> bytes:
    """Words as bytes: how many, their local ids, counts and sizes (32 bits each), and their letters end to end."""
    return b"".join([np.array([len(s)], "<u4").tobytes(), local.astype("<u4").tobytes(), n.astype("<u4").tobytes(),
                     (e - s).astype("<u4").tobytes(), data[TA.expand(s, e - s)].tobytes()])


def _read_dictionary(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(local ids, counts, sizes, letters) of :func:`_dictionary`."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    local, count, size = (np.frombuffer(raw, "<u4", n, 4 + 4 * n * k).astype(np.int64) for k in range(3))
    return local, count, size, np.frombuffer(raw, np.uint8, offset=4 + 12 * n)


def _cut_shards(n_buckets: int):
    """(lang, text) to the rows of ``_SHARDS``."""
    schema = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("lang", pa.string()), ("payload", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(0).fill_null(UNKNOWN).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], U)
            data, offs = TA.string_block(batch.column(1))
            offs, text_of = _cut_long(data, offs, SHARD_BYTES)
            for i, j, d, o in TA.blocks(data, offs, SHARD_BYTES):
                d = TA.LOWER[d]
                stream, s, e, kind, n = shard_words(d, o, code[text_of[i:j]])
                if len(n) == 0:
                    continue
                bucket = (TA.mix(TA.word_hashes(d, s, e) ^ salt[kind]) >> U(32)) * U(n_buckets) >> U(32)
                order = np.lexsort((bucket, kind))
                b, k = bucket[order].astype(np.int64), kind[order]
                edge = np.flatnonzero((np.diff(b, prepend=-1) != 0) | (np.diff(k, prepend=-1) != 0))
                rows = [(shard, -1, None, stream.astype("<u4").tobytes())]
                for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
                    some = order[lo:hi]
                    rows.append((shard, int(b[lo]), names[k[lo]], _dictionary(d, s[some], e[some], n[some], some)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                shard += 1
    return cut


def _add_words(n_buckets: int, min_count: int):
    """Word bucket step: the rows of ``_WORDS``. Frequent words with their ids and counts; for each shard, pairs of local
    and global id (64 bits each); and for each language the sum of all counts, with no word."""
    schema = pa.schema([("shard", pa.int64()), ("payload", pa.binary()), ("id", pa.int64()), ("lang", pa.string()),
                        ("word", pa.string()), ("f", pa.int64())])

    def add(table: pa.Table) -> pa.Table:
        bucket, shards = table.column("bucket")[0].as_py(), table.column("shard").to_numpy()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        if isinstance(langs, pa.ChunkedArray):
            langs = langs.unify_dictionaries().combine_chunks()
        names, code = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        local, count, size, letters = (np.concatenate(x) for x in zip(
            *(_read_dictionary(x.as_buffer()) for x in table.column("payload"))))
        words_of = np.array([int(np.frombuffer(x.as_buffer(), "<u4", 1)[0]) for x in table.column("payload")], np.int64)
        ends = np.cumsum(size)
        kind = np.repeat(code, words_of)
        first, place = distinct_words(letters, ends - size, ends, kind)
        f = np.zeros(len(first), np.int64)
        np.add.at(f, place, count)
        often = np.flatnonzero(f >= min_count)
        ids = np.zeros(len(first), np.int64)
        ids[often] = np.arange(len(often)) * n_buckets + bucket + 1
        at, many = first[often], len(often)
        letters_of = np.concatenate([[0], np.cumsum(size[at])]).astype(np.int32)
        words = pa.StringArray.from_buffers(many, pa.py_buffer(letters_of), pa.py_buffer(letters[TA.expand(ends[at] - size[at], size[at])]))
        none = pa.nulls
        vocabulary = [none(many, pa.int64()), none(many, pa.binary()), pa.array(ids[often]), names.take(pa.array(kind[at])), words, pa.array(f[often])]
        own, back = ids[place], []
        cut = np.concatenate([[0], np.cumsum(words_of)])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            known = np.flatnonzero(own[lo:hi]) + lo
            back.append(np.concatenate([local[known], own[known]]).astype("<i8").tobytes())
        n = len(back)
        answers = [pa.array(shards), pa.array(back, pa.binary()), none(n, pa.int64()), none(n, pa.string()), none(n, pa.string()), none(n, pa.int64())]
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, kind, count)
        m = len(sums)
        totals = [none(m, pa.int64()), none(m, pa.binary()), none(m, pa.int64()), names, none(m, pa.string()), pa.array(sums)]
        return pa.concat_tables([pa.Table.from_arrays([x.cast(y.type) for x, y in zip(part, schema)], schema=schema)
                                 for part in (vocabulary, answers, totals)])
    return add


def _count_shard(bits: int, size: int):
    """Cogroup step: the streams of a shard and the ids of its frequent words, to one filter per key bucket."""
    def count(streams: pa.Table, answers: pa.Table) -> pa.Table:
        pairs = [np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1) for x in answers.column("payload")]
        local, ids = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        lut = np.zeros(int(local.max(initial=-1)) + 2, U)
        lut[local + 1] = ids.astype(U)
        buckets, filters = [], []
        for raw in streams.column("payload"):
            stream = np.frombuffer(raw.as_buffer(), "<u4")
            w = lut[np.where(stream < len(lut), stream, 0)]
            two = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0))
            three = two[:-1][np.diff(two) == 1]
            keys = Q.pack([np.concatenate([w[two], w[three]]), np.concatenate([w[two + 1], w[three + 1]]),
                           np.concatenate([np.zeros(len(two), U), w[three + 2]])], size)
            hi, lo, n = Q.count_keys(*Q.permute(*keys, size))
            for b, i, j in zip(*(x.tolist() for x in Q.bucket_edges(lo, bits, size))):
                buckets.append(b)
                filters.append(Q.write_filter(hi[i:j], lo[i:j], n[i:j], bits, size))
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "filter": pa.array(filters, pa.binary())})
    return count


def _merge_bucket(bits: int, size: int, min_count: int):
    """Key bucket step: merge the filters and read the frequent n-grams back."""
    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        hi, lo, n = Q.merge_filters([x.as_py() for x in table.column("filter")], bucket, bits, size)
        keep = n >= min_count
        ids = Q.unpack(*Q.restore(hi[keep], lo[keep], size), size)
        return pa.table({**{f"w{k + 1}": pa.array(x.astype(np.int64)) for k, x in enumerate(ids)}, "a": pa.array(n[keep], pa.int64())})
    return merge


def frequent_ngrams(docs: DataFrame, min_count: int, text_col: str = "text",
                    lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, grams, totals): ``words`` (id, lang, word, f) and ``grams`` (w1, w2, w3, a; w3 is 0 for two words) that
    occur ``min_count`` times or more in a language, and ``totals`` (lang, n) with all word occurrences."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    n_buckets = int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BUCKET_BYTES) + 1
    shards = cut_lineage(texts.mapInArrow(_cut_shards(n_buckets), _SHARDS))
    found = cut_lineage(shards.where("bucket >= 0").groupBy("bucket").applyInArrow(_add_words(n_buckets, min_count), _WORDS))
    words = found.where("word is not null").select("id", "lang", "word", "f")
    totals = found.where("word is null and payload is null").groupBy("lang").agg(F.sum("f").alias("n"))
    totals = cut_lineage(totals)
    size = 3 * int(words.agg(F.max("id")).first()[0] or 1).bit_length()
    if size > 126:
        raise ValueError("more frequent words than 42-bit ids")
    total = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(int(2 * total // BUCKET_KEYS).bit_length(), size, 64)
    streams = shards.where("bucket = -1").select("shard", "payload")
    answers = found.where("payload is not null").select(F.col("shard").alias("of"), "payload")
    filters = streams.groupBy("shard").cogroup(answers.groupBy("of")).applyInArrow(_count_shard(bits, size), "bucket long, filter binary")
    grams = filters.groupBy("bucket").applyInArrow(_merge_bucket(bits, size, min_count), "w1 long, w2 long, w3 long, a long")
    return words, cut_lineage(grams), totals


def _look_up(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], weight: str, total: int) -> DataFrame:
    """``left`` with the ``values`` of the row of ``right`` that has its ``keys`` (ids; unique there, and always there).
    ``weight`` counts the occurrences of a key, ``total`` those of all: hot keys are broadcast, at most ``HOT`` rows, and
    rows that these answer are dealt at random in the shuffle of the others."""
    hot = F.col(weight) * HOT > total
    near = right.where(hot).select(*keys, *[F.col(v).alias(f"__near_{v}") for v in values])
    far = right.where(~hot).select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(v).alias(f"__far_{v}") for v in values])
    out = left.join(F.broadcast(near), keys, "left")
    done = F.col(f"__near_{values[0]}").isNotNull()
    anywhere = -F.lit(1) - F.pmod(F.xxhash64(*left.columns), F.lit(1 << 30))
    out = out.select("*", *[F.when(done, anywhere).otherwise(F.col(k)).alias(f"__{k}") for k in keys])
    out = out.join(far, [f"__{k}" for k in keys], "left")
    return out.select(*left.columns, *[F.coalesce(f"__near_{v}", f"__far_{v}").alias(v) for v in values])


def _score(l, r):
    """floor(1000000 a a / (l r)) in decimals, exact up to 10**15 occurrences."""
    wide = lambda c: c.cast("decimal(15,0)")
    a = wide(F.col("a"))
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (a * a), wide(l) * wide(r)).cast("long")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10,
                 absorb_percent: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: (lang, rank, phrase, words, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs.
    ``a`` is the number of occurrences, at least ``min_count``; a phrase scores floor(1000000 a a / (l r)) at its worst
    cut into two parts of l and r occurrences (the first of equal cuts); ``n`` is the number of words of the language.
    A phrase inside a longer candidate with ``absorb_percent`` of its occurrences or more is left out. Order: score,
    occurrences, then the phrase (UTF-8 bytes). A null text is empty, a null language is ``und``; an empty table gives no rows. Repeated rows
    count each time; other columns are ignored.
    """
    words, grams, totals = frequent_ngrams(docs, min_count, text_col, lang_col)
    total = int(totals.agg(F.sum("n")).first()[0] or 0)

    def word(left: DataFrame, k: int, **values: str) -> DataFrame:
        """``left`` with columns of its word ``k``."""
        side = words.select(F.col("id").alias(f"w{k}"), F.col("f").alias("__f"), *[F.col(c).alias(v) for v, c in values.items()])
        return _look_up(left, side, [f"w{k}"], list(values), "__f", total)

    two, three = grams.where("w3 = 0").drop("w3"), grams.where("w3 > 0")
    longer = (three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
              .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    pairs = two.join(longer, ["w1", "w2"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(absorb_percent) * F.col("a"))).drop("longer")
    pairs = word(word(pairs, 1, lang="lang", l="f"), 2, r="f").withColumn("score", _score(F.col("l"), F.col("r")))
    triples = _look_up(three, two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"], ["f12"], "f12", total)
    triples = _look_up(triples, two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")),
                       ["w2", "w3"], ["f23"], "f23", total)
    triples = word(word(triples, 1, lang="lang", f1="f"), 3, f3="f")
    triples = triples.withColumn("s1", _score(F.col("f1"), F.col("f23"))).withColumn("s2", _score(F.col("f12"), F.col("f3")))
    early = F.col("s1") <= F.col("s2")
    triples = triples.withColumns({"l": F.when(early, F.col("f1")).otherwise(F.col("f12")),
                                   "r": F.when(early, F.col("f23")).otherwise(F.col("f3")), "score": F.least("s1", "s2")})
    columns = ["lang", "w1", "w2", "w3", "a", "l", "r", "score"]
    found = cut_lineage(pairs.withColumn("w3", F.lit(0).cast("long")).select(*columns).unionByName(triples.select(*columns)))
    # the best ``top`` distinct (score, a) of a language hold its best ``top`` phrases, whatever the ties
    value = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    least = (found.select("lang", "score", "a").distinct().withColumn("k", F.row_number().over(value)).where(F.col("k") <= top)
             .groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least")))
    best = found.join(least, "lang").where(F.struct("score", "a") >= F.col("least")).drop("least")
    best = word(word(word(best, 1, t1="word"), 2, t2="word"), 3, t3="word")
    best = best.withColumn("words", F.array_compact(F.array("t1", "t2", "t3"))).withColumn("phrase", F.array_join("words", " "))
    # the limit is also taken within each partition before rows meet by language
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
