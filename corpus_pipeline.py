"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents
(doc_id, text, lang, source, n_chars). Rows are judged and dropped one by one, by a key of doc_id and text, so repeated
and null ids are safe; of rows equal in both, the second stage keeps one. To the suffix arrays rows of one id are one
document, and so are those without an id.
Nulls, empty texts and empty tables pass through as the operators define; a table without usable labels rejects none.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.llm.decontaminate import contamination
from kindling.llm.minhash import near_duplicates
from kindling.llm.pieces import load_pieces, round_trip_pieces
from kindling.llm.quality import fit_ranker, rank_quality
from kindling.llm.queries import PIECE_MODEL
from kindling.llm.suffix_dedup import suffix_dedup
from kindling.session import cut_lineage, scratch_root

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the pairwise-ranking classifier accepts; it learns from the labels that are not held out."""
    labels = _table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = fit_ranker(docs, labels, cut=0.3)
    return rank_quality(docs.select(*COLUMNS), model, score_col="__score", predicted_col="__good").where(
        "__good = 1").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a 64-bit key of each row's id and text; rows equal in both share it."""
    return docs.select(*COLUMNS).withColumn("__row", F.xxhash64("doc_id", "text"))


def _distinct_rows(docs: DataFrame) -> DataFrame:
    """One row of each set of rows equal in id and text, the one with the least other columns, with a key ``__row``.
    Only keys and the rows whose key occurs again are shuffled. Different rows that share a key get another one."""
    keyed = _keyed(docs)
    again = cut_lineage(keyed.groupBy("__row").count().where("count > 1").select("__row"))
    if again.isEmpty():
        return keyed
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    more = (keyed.join(again, "__row", "left_semi").groupBy("__row", "doc_id", "text")
            .agg(F.min(F.struct(*rest)).alias("r")).select("__row", "doc_id", "text", "r.*"))
    clash = more.groupBy("__row").count().where("count > 1").select("__row", F.lit(True).alias("clash"))
    more = more.join(clash, "__row", "left").withColumn(
        "__row", F.when(F.col("clash"), F.xxhash64(F.lit(1), "text", "doc_id")).otherwise(F.col("__row")))
    return keyed.join(again, "__row", "left_anti").unionByName(more.drop("clash"))


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose ``__row`` is not rejected. The rejected keys are written first: Spark then knows their size and
    broadcasts a small list instead of shuffling all texts, and joins by shuffle beyond its threshold."""
    return keyed.join(cut_lineage(rejected.select("__row").distinct()), "__row", "left_anti").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id (null: the largest) of each group of near duplicates."""
    keyed = _distinct_rows(docs)
    named = cut_lineage(near_duplicates(keyed, id_col="__row").select("__row", "component_id")
                        .join(keyed.select("__row", "doc_id"), "__row"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row"))
    kept = named.groupBy("component_id").agg(least.alias("least")).select("least.__row")
    return _without(keyed, named.join(kept, "__row", "left_anti"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes from each text the characters that 50-byte strings of documents with smaller ids cover."""
    out = suffix_dedup(docs, width=50, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.length("kept_text").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the benchmark's 13-word windows contaminate."""
    wide = F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64(F.lit(1), "text", "doc_id").alias("y"))  # 128 bits
    keyed = docs.select(*COLUMNS).withColumn("__row", wide)
    found = contamination(keyed, _table(spark, sf_dir, "benchmark"), id_col="__row")
    return _without(keyed, found.where("contaminated"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with a check that they decode to it."""
    out = round_trip_pieces(docs.select(*COLUMNS), load_pieces(PIECE_MODEL))
    return out.select("doc_id", "lang", "source", "n_chars", "ids",
                      F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
                      F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: suffix arrays, classifiers and tokenizers have no SQL form; run() is tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written to the shared scratch folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = os.path.join(scratch_root(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
