"""The training-data pipeline: STAGES over documents, each on what its predecessor kept.

Every stage but the last takes and gives the columns of documents (doc_id, text, lang,
source, n_chars); rows may miss any value. Rows that share a doc_id, or have none, are
documents of their own in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, importance, mixing, simhash, suffixes
from loomtext.llm.common import key_filter, materialize, passing, read_table, row_keys

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a string that counts as repeated: 51 words of five bytes, blanks included.
REPEAT_BYTES = 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the importance classifier samples as good."""
    judged = importance.classify(docs, read_table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (five words, 0.8): the smallest doc_id's."""
    keyed = row_keys(docs)
    groups = simhash.similar_documents(keyed.select(F.col("_row").alias("doc_id"), "text"), width=5)
    rows = groups.select(F.col("doc_id").alias("_at"), "component_id").join(keyed.select("doc_id", "_row"), F.col("_at") == F.col("_row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    kept = rows.groupBy("component_id").agg(first.alias("one")).select(F.col("one._row").alias("_at"))
    gone = materialize(groups.select(F.col("doc_id").alias("_at")).join(kept, "_at", "left_anti"), "gone")
    # Few rows go: only those that a filter of them lets through are joined.
    concerned = key_filter(gone, "_at")
    left = passing(keyed, "_row", concerned).join(gone, F.col("_row") == F.col("_at"), "left_anti")
    return passing(keyed, "_row", concerned, inside=False).unionByName(left).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every string of REPEAT_BYTES that repeats out of the texts; a character cut in part stays."""
    keyed = row_keys(docs)
    cut = suffixes.remove_repeats(keyed.select(F.col("_row").alias("doc_id"), "text"), characters=True, length=REPEAT_BYTES)
    cut = materialize(cut.where("n_removed > 0").select(F.col("doc_id").alias("_cut"), F.decode(F.col("kept"), "utf-8").alias("_text")), "cut")
    concerned = key_filter(cut, "_cut")
    joined = passing(keyed, "_row", concerned).join(cut, F.col("_row") == F.col("_cut"), "left")
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.col("_text"))
    changed = joined.withColumn("text", text).withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return passing(keyed, "_row", concerned, inside=False).select(*docs.columns).unionByName(changed.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the entropy-balanced mix says."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and how many decode back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe.decode(bpe.encode(docs, path), path)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]
#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
