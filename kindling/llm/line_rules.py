"""Quality rules with DataFrame functions only: base counts of a text, and lines that many documents of a host share.

Lines are normalised (A-Z in lower case, outer white space off, inner runs one space), hashed, and counted by the
distinct documents of their host. Lines above the limit are boilerplate; a document that keeps too little of its
words without them is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[ \\t\\n\\x0B\\f\\r]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_HOST_DOCS = 5  # a line of so few documents of a host stays
MIN_KEPT_PERCENT = 30  # words a document must keep


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def run_hashes(hashes: Column, width: int) -> Column:
    """Hash of every run of ``width`` words, from the word hashes of a text."""
    return F.when(F.size(hashes) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - width),
                    lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))


def base_counts(docs: DataFrame, text_col: str = "text", width: int = 8) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text.

    A null or empty text has zeros. n_dup_lines counts the lines with a word that equal an earlier line. A text
    without a repeated run (most) stops at the distinct count of its run hashes; the others sort (hash, position)
    pairs, keep those with an equal neighbour and add up what their positions cover.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACE_CHARS) != "")
    out = docs.withColumn("__h", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))
    out = out.withColumn("__runs", run_hashes(F.col("__h"), width))
    out = out.withColumn("n_words", F.size("__h").cast("long"))
    out = out.withColumn("word_chars", F.length(_without(text, SPACE_CHARS)).cast("long"))
    out = out.withColumn("n_symbols", (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    has = F.size(F.array_distinct("__runs")) < F.size("__runs")
    out = out.withColumn("__p", F.when(has, F.array_sort(F.transform(
        "__runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("__p")
    out = out.withColumn("__p", F.when(has, F.array_sort(F.transform(F.filter(
        p, lambda x, k: F.coalesce(F.get(p, k - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(p, k + 1).h == x.h, F.lit(False))),
        lambda x: x.i))))
    covered = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct(
        (a.n + i + width - F.greatest(a.end, i)).alias("n"), (i + width).alias("end")), lambda a: a.n)
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(has, covered), F.lit(0)).cast("long"))
    return out.drop("__h", "__runs", "__p")


def normal_line(line: Column) -> Column:
    """A line with A-Z in lower case, without outer white space, inner runs of it as one space."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, SPACES, " "))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               width: int = 8, min_words: int = 20, max_repeat_percent: int = 30, min_host_docs: int = MIN_HOST_DOCS,
               min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, n_line_words (words in removed lines), kept_text, kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in repeated runs.
    A line is removed if more than ``min_host_docs`` distinct documents of its host hold it, however many documents the
    host has. A document is kept if it passed the base rules and at least
    ``min_kept_percent`` percent of its words stand in other lines; kept_text has those lines. A null host is a host of
    its own; rows that repeat an id are one document to the line counts and keep the lines of their own text; a null
    id is a document too. An empty table gives an empty result.
    """
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[host_col]).alias("host"))
    d = d.withColumn("key", F.xxhash64("id", "text", "host")).withColumn("doc", F.xxhash64("id"))
    lines = d.select("doc", "key", "host", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    lines = lines.withColumn("line", normal_line(F.col("line"))).where("line <> ''").select(
        "doc", "key", "host", F.xxhash64("line").alias("line"), "at", F.size(F.split("line", " ")).alias("n"))
    frequent = (lines.groupBy("host", "line", "doc").agg(F.lit(1).alias("one"))
                .groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_host_docs)
                .select("host", "line"))
    gone = (lines.select("key", "host", "line", F.struct("at", "n").alias("place")).join(frequent, ["host", "line"])
            .groupBy("key").agg(F.collect_set("place").alias("places")))  # equal rows give equal places
    gone = gone.select("key", F.sort_array(F.transform("places", lambda x: x.at)).alias("removed"),
                       F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("gone"))
    base = base_counts(d, "text", width).join(gone, "key", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    # the lines between two removed ones are one slice: linear in the lines, however many are removed
    base = base.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n")).withColumn(
        "removed", F.coalesce("removed", F.array().cast("array<int>")))
    first = lambda k: F.coalesce(F.get("removed", k - 1) + 2, F.lit(1))
    last = lambda k: F.coalesce(F.get("removed", k), F.size("lines"))
    kept_lines = F.flatten(F.transform(F.sequence(F.lit(0), F.size("removed")),
                                       lambda k: F.slice("lines", first(k), last(k) - first(k) + 1)))
    return base.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("gone").alias("n_line_words"), F.array_join(kept_lines, "\n").alias("kept_text"),
        (~failed & (100 * (F.col("n_words") - F.col("gone")) >= min_kept_percent * F.col("n_words"))).alias("kept"))
