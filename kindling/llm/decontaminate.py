"""Benchmark decontamination with DataFrame functions only: winnowing, then extension on the words themselves.

A window of L words has L + 1 - k k-grams; its fingerprint is their least hash. Equal windows have equal fingerprints,
so keeping one fingerprint per window (neighbours mostly share it) guarantees that every shared window is found, and
only windows whose fingerprint a benchmark window has are compared word by word. Items shorter than the window are
windows of their own length; each length that occurs is winnowed with its own k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000  # benchmark windows up to which their fingerprints are broadcast (8 bytes each)


def item_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _with_prints(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` (with ``words``) and the fingerprint of each window of ``length`` words as ``prints``.

    Word hashes, k-gram hashes and fingerprints are columns of their own, so that no lambda computes the array it
    looks things up in."""
    k = (length + 1) // 2
    per_window = length + 1 - k
    n, none = F.size("h"), F.array().cast("array<bigint>")
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.lit(length), *[F.get("h", i + j) for j in range(k)]))
    out = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("grams", F.when(n < length, none).otherwise(grams))
    prints = F.col("grams")
    if per_window > 1:
        prints = F.when(n < length, none).otherwise(F.transform(
            F.sequence(F.lit(0), n - length), lambda i: F.least(*[F.get("grams", i + j) for j in range(per_window)])))
    return out.withColumn("prints", prints).drop("h", "grams")


def _window_text(words: Column, at: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, at + 1, length), " ")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", length: int = 13, min_percent: int = 5,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted strings), contaminated.

    A word is hit if a window of ``length`` words of some item, or a whole shorter item, covers it; items without
    words take no part, items without an id are not named in ``items``. contaminated: n_hit > 0 and 100 * n_hit >= min_percent * n_words. A null text has no
    words. Rows that repeat an id are judged each by its text. An empty table of documents gives an empty result,
    without items nothing is hit. The benchmark's fingerprints are broadcast after they have been counted, and joined
    by shuffle beyond ``broadcast_rows``.
    """
    bench = items.select(items[item_col].cast("string").alias("item"), item_words(items[item_text]).alias("words"))
    bench = bench.where(F.size("words") > 0).withColumn(
        "length", F.least(F.size("words"), F.lit(length)))
    lengths = [r[0] for r in bench.select("length").distinct().orderBy("length").collect()]  # at most ``length`` numbers
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    d = d.withColumn("key", F.struct(F.xxhash64("id", "text"), F.xxhash64(F.lit(1), "text", "id")))  # 128 bits
    worded = d.select("key", item_words(F.col("text")).alias("words"))

    bench_windows = found = None
    item_prints = {}
    for n in lengths:
        own = _with_prints(bench.where(F.col("length") == n), n)
        # exploded from an expression: from a column, Spark would push a copy of its whole formula below the projections
        own = own.select("item", "words", F.explode(F.transform(
            "prints", lambda p, i: F.struct(p.alias("print"), i.alias("at")))).alias("x")).select("item", "words", "x.*")
        windows = own.select(F.lit(n).alias("length"), "item", "print", _window_text(F.col("words"), F.col("at"), n).alias("window"))
        prints = windows.select("print").distinct()
        few = prints.count() <= broadcast_rows
        item_prints[n] = prints, few
        mine = _with_prints(worded, n).select("key", F.explode(F.array_distinct("prints")).alias("print"))
        hit = mine.join(F.broadcast(prints) if few else prints, "print").withColumn("length", F.lit(n))
        hit = hit.select("key", "length").distinct()
        bench_windows = windows if bench_windows is None else bench_windows.unionByName(windows)
        found = hit if found is None else found.unionByName(hit)
    n_words = d.select("id", "key", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    if found is None:
        out = n_words.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    else:
        bench_windows = bench_windows.select("length", "item", "window").distinct()
        # the words of the documents that share a fingerprint, written once for the passes below; their keys are written
        # first, so that the join knows how few they are and need not shuffle the texts
        near = cut_lineage(found.groupBy("key").agg(F.collect_set("length").alias("lengths")))
        near = cut_lineage(worded.join(near, "key"))
        at = None
        for n in lengths:
            w = _with_prints(near.where(F.array_contains("lengths", n)), n)
            # places travel without the words: a row of one window must not carry its whole text
            w = w.select("key", F.explode(F.transform("prints", lambda p, i: F.struct(p.alias("print"), i.alias("at")))).alias("x"))
            prints, few = item_prints[n]
            w = w.select("key", "x.*").join(F.broadcast(prints) if few else prints, "print")
            w = w.select("key", F.struct("at", F.lit(n).alias("length")).alias("place"))
            at = w if at is None else at.unionByName(w)
        at = at.groupBy("key").agg(F.collect_set("place").alias("places"))
        compared = near.select("key", "words").join(at, "key").select("key", F.explode(F.transform("places", lambda x: F.struct(
            x["length"].alias("length"), x["at"].alias("at"),
            _window_text(F.col("words"), x["at"], x["length"]).alias("window")))).alias("x")).select("key", "x.*")
        same = bench_windows.select("length", "window").distinct()
        hits = cut_lineage(compared.join(same, ["length", "window"]))
        places = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "length"))).alias("places"))
        covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct(
            (a.n + F.greatest(F.lit(0), x.at + x.length - F.greatest(a.end, x.at))).alias("n"),
            F.greatest(a.end, x.at + x.length).alias("end")), lambda a: a.n)
        places = places.select("key", covered.cast("long").alias("n_hit"))
        named = (hits.select("key", "length", "window").distinct().join(bench_windows, ["length", "window"])
                 .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")))
        out = n_words.join(places.join(named, "key"), "key", "left").withColumns({
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items",
                      ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words"))).alias("contaminated"))
