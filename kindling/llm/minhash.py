"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets and star-shaped candidates.

Each distinct shingle set (texts with equal sets are one class) is hashed once: a shingle falls into one of
``bands * rows`` bins and the least value of a bin is kept; an empty bin copies the bin that a universal hash of
(bin, attempt) names, at the first attempt that names a filled one. Bands of ``rows`` bins are bucket keys. A bucket
gives one candidate link per member, to its least member, so candidates grow with members and not with pairs.
Candidates are confirmed on the full sets, and components follow.

A star alone could lose a link between two members that its centre does not connect. Buckets whose members are still
in more than one component get a second star, around a centre that differs by bucket. The texts of those that then hold
more than one component are joined once more, exactly: with all shingles in one order, rarest
first, two sets that are similar enough share a shingle among the first ones of both (a quarter of the larger set, a
seventh of the smaller). Only pairs across components that meet so, and whose sizes and places in the order leave room
for the threshold, are confirmed. Pages of one template differ in their rarest shingles, so they do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm import exchange as X
from kindling.llm import textarrays as TA
from kindling.llm.components import connected_components
from kindling.session import cut_lineage

U = np.uint64
BANDS, ROWS = 36, 4
BLOCK = 256  # rows of one join key that are never dealt to several tasks
HOT_KEYS = 10_000  # at most so many keys can hold more than this part of all rows
MAX_ATTEMPTS = 4096


def shingle_sets(texts, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of documents (i, j): the distinct shingle hashes of each, end to end and ascending, and the offsets."""
    data, offs = TA.string_block(texts)
    for i, j, d, o in TA.blocks(TA.LOWER[data], offs):
        s, e, wo = TA.words(d, o)
        p = TA.prefix_hash(TA.word_hashes(d, s, e), TA.BASE_A)
        n = np.diff(wo)
        counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))  # a shorter text is one shingle
        at = TA.expand(wo[:-1], counts)
        doc = np.repeat(np.arange(j - i), counts)
        h = TA.range_hash(p, at, np.minimum(at + size, wo[doc + 1]), TA.BASE_A)
        (doc, h), _, _ = X.distinct(doc, h)
        yield i, j, h, np.searchsorted(doc, np.arange(j - i + 1))


def signatures(h: np.ndarray, offs: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification: (documents, bins) of uint64; each must have a shingle."""
    n = len(offs) - 1
    top = np.iinfo(np.uint64).max
    sig = np.full(n * bins, top, dtype=U)
    x = TA.mix(h ^ U(TA.BASE_B))
    doc = np.repeat(np.arange(n), np.diff(offs))
    np.minimum.at(sig, doc * bins + ((x >> U(32)) * U(bins) >> U(32)).astype(np.int64), TA.mix(x) >> U(1))
    sig = sig.reshape(n, bins)
    filled = sig != top
    rows = np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1))
    for attempt in range(1, MAX_ATTEMPTS):
        if len(rows) == 0:
            break
        named = (TA.mix(np.arange(bins, dtype=U) * U(TA.BASE_A) + U(attempt)) % U(bins)).astype(np.int64)
        part = sig[rows]
        use = (part == top) & filled[rows][:, named]
        source = np.where(filled[rows][:, named], sig[rows][:, named], top)
        # only bins filled by shingles are copied, never copies
        part[use] = source[use]
        sig[rows] = part
        rows = rows[(part == top).any(axis=1)]
    for r in rows:  # bins that no attempt has named a filled bin for
        sig[r][sig[r] == top] = sig[r][filled[r]][0]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per document and band."""
    out = np.empty((len(sig), bands), dtype=U)
    for b in range(bands):
        key = np.full(len(sig), b + 1, dtype=U)
        for r in range(rows):
            key = TA.mix(key * U(TA.BASE_A) + sig[:, b * rows + r])
        out[:, b] = key
    return out


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _spread_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, block: int, how: str = "inner") -> DataFrame:
    """``rows`` (with an id) joined with ``keyed``, whose ``weight`` is the number of rows of its unique ``key``.

    A key with more than ``block`` rows and more than 1 / HOT_KEYS of all is dealt in parts by a hash of the id. There
    are less than HOT_KEYS such keys whatever the input, so their list is broadcast.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    share = max(block, total // HOT_KEYS + 1)
    parts = F.ceil(F.col(weight) / share).cast("int")
    hot = keyed.where(F.col(weight) > share).select(key, parts.alias("__parts"))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__part", F.pmod(F.xxhash64("id"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    keyed = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.join(keyed, [key, "__part"], how).drop("__part")


def _profile(size: int, bands: int, rows: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, offs in shingle_sets(batch.column("text"), size):
                n = np.diff(offs)
                k1 = TA.range_hash(TA.prefix_hash(h, TA.BASE_A), offs[:-1], offs[1:], TA.BASE_A)
                k2 = TA.range_hash(TA.prefix_hash(h, TA.BASE_B), offs[:-1], offs[1:], TA.BASE_B)
                some = np.flatnonzero(n)
                sig = signatures(h, np.append(offs[some], len(h)), bands * rows)
                keys = _signed(band_keys(sig, bands, rows))
                at = np.zeros(j - i + 1, np.int32)
                at[1:] = np.cumsum((n > 0) * bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(n, pa.int64()),
                     pa.array(_signed(k1)), pa.array(_signed(k2)),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))],
                    names=["id", "n", "k1", "k2", "bands"])
    return profile


PROFILE_SCHEMA = "id long, n long, k1 long, k2 long, bands array<long>"


def _confirm(size: int, percent: int):
    """Keeps the links whose full shingle sets have 100 * intersection >= percent * union."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pairs, hashes = [], [], []
            for name in ("text_a", "text_b"):
                size_of, pair, hash_ = np.zeros(batch.num_rows, np.int64), [], []
                for i, j, h, offs in shingle_sets(batch.column(name), size):
                    size_of[i:j] = np.diff(offs)
                    pair.append(np.repeat(np.arange(i, j), np.diff(offs)))
                    hash_.append(h)
                sizes.append(size_of)
                pairs += pair
                hashes += hash_
            if not pairs:
                continue
            (pair, _), _, count = X.distinct(np.concatenate(pairs), np.concatenate(hashes))
            both = np.bincount(pair[count == 2], minlength=batch.num_rows)
            ok = (100 * both >= percent * (sizes[0] + sizes[1] - both)) & (both > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (batch.column("a"), batch.column("b"))],
                                             names=["a", "b"])
    return confirm


def _shingles(size: int):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, offs in shingle_sets(batch.column("text"), size):
                # a repeated id may have several texts; their sets are told apart
                text = TA.range_hash(TA.prefix_hash(h, TA.BASE_A), offs[:-1], offs[1:], TA.BASE_A)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(_signed(text)),
                     pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(_signed(h)))],
                    names=["id", "text", "shingles"])
    return shingles


def _meeting(texts: DataFrame, components: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """(a, b): pairs of ids in different components, among which are all that have 100 * intersection >= percent * union.

    ``components`` is (id, comp). Such a pair shares at least need = percent * (n + m) / (100 + percent) shingles, so
    in any order of all shingles the first n - need + 1 of the one and m - need + 1 of the other have one in common;
    from the first common one on, both must have need left. A shingle of one text alone can join nothing.
    """
    sets = cut_lineage(texts.join(components, "id").select("id", "text").mapInArrow(
        _shingles(size), "id long, text long, shingles array<long>"))
    each = sets.select("id", "text", F.explode("shingles").alias("shingle"))
    counts = cut_lineage(each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"))
    ranked = _spread_join(each, counts, "shingle", "c", block, "left").groupBy("id", "text").agg(
        F.array_sort(F.collect_set(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "shingle"))).alias("s"))
    ranked = ranked.withColumn("n", F.size("s").cast("long"))
    first = ranked.select("id", "n", F.posexplode(F.expr(f"slice(s, 1, int(n - (n * {percent} + 99) div 100 + 1))")))
    first = first.where("col.c > 1").select("id", "n", (F.col("pos") + 1).alias("pos"), F.col("col.shingle").alias("shingle"))
    first = cut_lineage(first.join(components, "id"))
    whole = 100 + percent
    small = first.where(f"pos <= n - (2 * n * {percent} + {whole - 1}) div {whole} + 1")
    pairs = first.alias("p").join(small.alias("q"), F.expr(f"""
        p.shingle = q.shingle and p.comp <> q.comp and (p.n > q.n or (p.n = q.n and p.id > q.id))
        and 100 * q.n >= {percent} * p.n
        and {whole} * (least(p.n - p.pos, q.n - q.pos) + 1) >= {percent} * (p.n + q.n)"""))
    return pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set is its distinct ``size``-word shingles, or
    its whole sequence if it has fewer words. Texts are linked if 100 * intersection >= percent * union;
    component_id is the least id reachable over links and kept says whether it is the row's own. A null or empty
    text has an empty set and no link. Integer ids; rows with a null id take no part (component_id null, kept true);
    rows that repeat an id
    are judged each by its text, and linked to others by any of them. Other columns are ignored; an empty table gives an empty result.

    A join key (bucket or shingle) of up to ``block`` rows is never dealt to several tasks.
    Texts with equal sets are linked exactly. For two different sets at the threshold, the chance that none of
    ``bands`` buckets holds both is (1 - t**rows)**bands, about 1e-6 with the defaults, and less above it.
    """
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    profiles = cut_lineage(d.mapInArrow(_profile(size, bands, rows), PROFILE_SCHEMA))
    usable = profiles.where("n > 0 and id is not null")

    # classes of equal sets, each a node named by its least id
    classes = cut_lineage(usable.groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands")))
    in_band = classes.select("id", F.explode("bands").alias("bucket"))
    hubs = cut_lineage(in_band.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1"))
    members = cut_lineage(_spread_join(in_band, hubs, "bucket", "m", block))

    # texts that share a bucket with another; all later steps read only these
    texts = cut_lineage(d.join(members.select("id").distinct().hint("merge"), "id", "left_semi"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
                .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
        return cut_lineage(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long")
                           .distinct())

    links = confirmed(members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    reached = connected_components(links)

    def open_members(reached: DataFrame) -> DataFrame:
        """Members of buckets that still hold more than one component, each with another centre than the least id; one of
        two members has been compared by its star."""
        placed = members.where("m > 2").join(reached.withColumnRenamed("node", "id"), "id", "left").select(
            "bucket", "id", F.coalesce("component", "id").alias("comp"))
        centre = F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id", "comp")).alias("centre")
        open_ = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), centre)
        return _spread_join(placed, cut_lineage(open_.where("lo <> hi").select("bucket", "m", "centre")), "bucket", "m", block)

    # a second star of each, around a centre that differs by bucket: a member meets up to ``bands`` different centres
    stars = open_members(reached).where("comp <> centre.comp").select(
        F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()
    links = cut_lineage(links.unionByName(confirmed(stars)))
    reached = connected_components(links)
    again = cut_lineage(open_members(reached).select("id", "comp").distinct())
    more = _meeting(texts, again, size, percent, block)
    links = links.unionByName(confirmed(cut_lineage(more)))
    reached = connected_components(links)

    named = classes.select("k1", "k2", "id").join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "k1", "k2", F.coalesce("component", "id").alias("found"))
    out = profiles.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("found")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
