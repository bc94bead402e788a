"""A corpus pipeline: quality rules, near-duplicates, repeated passages, source mixing, BPE encoding.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and returns documents with
the same columns; the last returns the encoded form.

Null texts count as empty: the quality rules reject them, later stages keep them as they are.  Null languages and sources
are values of their own, null ids come last.  Rows that share an id are told apart by their text; wholly equal rows pass
the quality rules together, and one of them stays after the near-duplicates.  Further columns are dropped.  An empty table
stays empty with the columns of its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbgrid.llm import bpe, mixing, passages, quality, simhash
from plumbgrid.llm.queries import tokenizer_file
from plumbgrid.workspace import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Rows are told apart by id and text."""
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))
    verdicts = quality.quality(keyed.select(F.col("key").alias("doc_id"), "text", "lang", "source"))
    kept = verdicts.where("kept").select(F.col("doc_id.doc_id").alias("k"), F.col("doc_id.h").alias("h"))
    on = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("key.h") == F.col("h"))
    return keyed.join(kept, on, "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a five-word similarity of 0.8: the one with the smallest id, of rows that share it one by text digest.

    Groups are told apart by their links, not by their ids: texts without an id, or with the same one, stay if they are in
    different groups.  Equal rows (id and text) stay once, with the smallest source, language and size.
    """
    found = simhash.similar_groups(docs)
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("m"))
    heads = first.select(F.col("m.doc_id").alias("k"), F.col("m.digest").alias("h")).hint("merge")  # a row for each group is no broadcast
    keyed = docs.select(*COLUMNS, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    stay = keyed.join(heads, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("h")), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("source", "lang", "n_chars"))
    return stay.withColumn("rank", rank).where("rank = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier elsewhere; documents of which nothing is left go."""
    cut = passages.remove_repeats(docs, carry=("lang", "source")).where("n_words = 0 or n_removed < n_words")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with digests of the ids and of their decoding."""
    return bpe.encode_texts(docs, tokenizer_file(), full=True).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Robust estimates, 64-bit hashes and BPE are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
