"""Published derivatives: staged, audited, bound to a policy, and renamed into place.

A published folder holds `data` (Parquet), MANIFEST.json (every part with its rows and
hash) and AUDIT.json (the policy's fingerprint and the caller's findings). It appears as a
whole or not at all, and a second run under the same identity reuses it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import body_hash, stable_id
from loomtext.sources.records import fingerprint, inventory, row_hash, verify_inventory


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file through Spark's file systems."""
    where, fs = _path(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    lines = spark.read.text(path, wholetext=True).first()
    return lines["value"] if lines else ""


def policy_fingerprint(policy: dict) -> str:
    """A hash of rules and settings, whatever the order of their names."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def publish(df: DataFrame, target: str, policy: dict, audit: dict | None = None) -> str:
    """Publish a table under `target`; "created", or "reused" where it is there already.

    A target with another policy or other rows is an error: nothing published is replaced.
    """
    spark = df.sparkSession
    identity = {"policy": policy_fingerprint(policy), "rows": fingerprint(df)}
    known = get_text(spark, f"{target}/AUDIT.json")
    if known is not None:
        if json.loads(known)["identity"] != identity:
            raise FileExistsError(f"{target} holds another derivative")
        return "reused"
    stage = f"{target}.stage-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(f"{stage}/data")
    parts = [r.asDict() for r in inventory(spark, f"{stage}/data").orderBy("file").collect()]
    put_text(spark, f"{stage}/MANIFEST.json", json.dumps({"parts": parts}, sort_keys=True))
    put_text(spark, f"{stage}/AUDIT.json", json.dumps({"identity": identity, "audit": audit or {}}, sort_keys=True))
    source, fs = _path(spark, stage)
    if not fs.rename(source, _path(spark, target)[0]):
        raise FileExistsError(f"{target} appeared meanwhile")
    return "created"


def published_issues(spark: SparkSession, target: str) -> DataFrame:
    """Parts of a published table that are not what its manifest says."""
    parts = json.loads(get_text(spark, f"{target}/MANIFEST.json"))["parts"]
    expected = spark.createDataFrame([(p["file"], p["rows"], p["sha256"]) for p in parts], "file string, rows long, sha256 string")
    return verify_inventory(spark, f"{target}/data", expected)


def corpus_tables(raw: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> dict[str, DataFrame]:
    """sources, documents, passages and lineage of raw records.

    A passage is a distinct body; lineage keeps every raw row and names its passage.
    """
    named = raw.select(F.col(key).alias("raw_key"), F.coalesce(F.col(source), F.lit("unknown")).alias("source"), F.col(text).alias("text"))
    ids = named.select("*", stable_id("src", F.col("source")).alias("source_id"), stable_id("doc", F.col("source"), F.col("raw_key")).alias("document_id"), body_hash(F.coalesce("text", F.lit(""))).alias("body_sha256"))
    keyed = ids.withColumn("passage_id", stable_id("pas", F.col("body_sha256")))
    return {
        "sources": keyed.select("source_id", "source").distinct(),
        "documents": keyed.select("document_id", "source_id").distinct(),
        "passages": keyed.groupBy("passage_id", "body_sha256").agg(F.min("text").alias("text")),
        "lineage": keyed.select("raw_key", "document_id", "passage_id"),
    }


def write_corpus(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write the four tables, register them as views, and give their joined view."""
    for name, frame in tables.items():
        frame.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{name}")
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(f"corpus_{name}")
    return spark.sql("SELECT * FROM corpus_lineage JOIN corpus_passages USING (passage_id) JOIN corpus_documents USING (document_id) JOIN corpus_sources USING (source_id)")


def export_csv(spark: SparkSession, queries: dict[str, str], folder: str) -> DataFrame:
    """Write each SQL query as one CSV folder; gives (name, rows, sha256) of what was written."""
    found = []
    for name, text in sorted(queries.items()):
        frame = spark.sql(text)
        frame.write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")
        back = spark.read.option("header", True).csv(f"{folder}/{name}")
        found.append((name, back.count(), hashlib.sha256(fingerprint(back).encode()).hexdigest()))
    return spark.createDataFrame(found, "name string, rows long, sha256 string")


def bridge(batches: Iterable[pa.RecordBatch], path: str, rows: int = 25_000) -> int:
    """Write Arrow batches of another engine as Parquet row groups; gives their rows."""
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    count, writer = 0, None
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            writer = writer or pq.ParquetWriter(f"{base}/part-00000.parquet", part.schema, filesystem=fs, compression="zstd")
            writer.write_batch(part)
            count += part.num_rows
    if writer:
        writer.close()
    return count


def insert_same(existing: DataFrame, fresh: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicts): a key that is there with equal values adds nothing.

    A key with other values, there or within the fresh rows, is a conflict.
    """
    hashed = lambda df: df.withColumn("_h", row_hash(df))
    new = hashed(fresh).groupBy(*key).agg(F.min("_h").alias("_low"), F.max("_h").alias("_high"), F.first(F.struct(*fresh.columns)).alias("_row"))
    both = new.join(hashed(existing).select(*key, F.col("_h").alias("_old")), key, "left")
    clash = (F.col("_low") != F.col("_high")) | (F.col("_old").isNotNull() & (F.col("_old") != F.col("_low")))
    return both.where(~F.coalesce(clash, F.lit(False)) & F.col("_old").isNull()).select("_row.*"), both.where(clash).select(*key)


def upserted(existing: DataFrame, fresh: DataFrame, key: list[str], update: bool) -> DataFrame:
    """The table after an upsert: known keys keep their row, or take the fresh one."""
    winner, loser = (fresh, existing) if update else (existing, fresh)
    return winner.unionByName(loser.join(winner.select(*key), key, "left_anti").select(*winner.columns))


def resumable(jobs: DataFrame, receipts: DataFrame, work: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """Receipts of the jobs (job_id, cursor) that have none yet, after their work.

    Work gives (job_id, cursor, n). A job whose receipt names its cursor is not done
    again, so a run that was stopped goes on where it ended.
    """
    open_ = jobs.join(receipts.select("job_id", "cursor"), ["job_id", "cursor"], "left_anti")
    return work(open_.orderBy("job_id", "cursor").limit(limit) if limit else open_)
