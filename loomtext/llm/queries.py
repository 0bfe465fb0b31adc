"""The queries of the training-data operators, as __spark_entry__.py registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import ann, audio, bpe, importance, kdtree, mixing, simhash, suffixes, token_files, warc
from loomtext.llm.common import read_table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the word-end vocabulary."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return texts.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weigh all documents by target over raw n-grams and sample the good ones."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return importance.classify(docs.select("doc_id", "text"), labels, narrow=True).select("doc_id", "log_weight", "logit", "key", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every 400-byte string that starts anywhere else too."""
    cut = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 3-word SimHash fingerprints at two bits."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, max_bits=2)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convert every page through ARC to WARC archives and read them back."""
    read = warc.read_archives(spark, warc.write_archives(read_table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as 8-bit samples, read it back and compute features."""
    found = audio.read_features(audio.features(audio.store_media(read_table(spark, sf_dir, "documents"))))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector by adaptive dimension scan."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all token ids as byte planes and read them back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_files.write_token_files(read_table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, folder, digest=True)


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to their sources' targets."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op10_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all documents into 40 shards of near equal bytes."""
    found = kdtree.assign(read_table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_importance_quality": op2_importance_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash_near_duplicates": op4_simhash_near_duplicates,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_audio_features": op6_audio_features,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_token_planes": op8_token_planes,
    "op9_entropy_mix": op9_entropy_mix,
    "op10_kdtree_shards": op10_kdtree_shards,
}
ORACLES: dict[str, str] = {}
