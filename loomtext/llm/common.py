"""Shared plumbing of the training-data operators: tables, the shared folder, sizes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on one machine (a local master) gets a folder in the
    warehouse; on a cluster that is an error, as no folder is known to be shared.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_before = sc._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get().rstrip("/")
        sc.setCheckpointDir(f"file:///tmp/loomtext-{uuid.uuid4().hex[:12]}")
        named = sc._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def _release() -> None:
    """Give memory that a finished task has freed back to the system.

    Python workers live on from task to task; what their allocators keep would add up
    over the steps of a job.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow whose worker gives its memory back at the end of a task."""

    def held(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(rows)
        finally:
            _release()

    return held


def lean_group(run: Callable[[pa.Table], pa.Table], least: int = 1 << 20):
    """The same for applyInArrow, after groups of `least` bytes or more."""

    def held(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >= least:
            _release()
        return out

    return held


def lean_pair(run: Callable[[pa.Table, pa.Table], pa.Table], least: int = 1 << 20):
    """The same for applyInArrow on cogroups."""

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        if left.nbytes + right.nbytes >= least:
            _release()
        return out

    return held


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of the Arrow batches that go to Python workers, where the session has the default.
BATCH_ROWS = 2_500


def small_batches(spark: SparkSession) -> None:
    """Pass texts to Python in smaller batches than Spark's default of 10,000 rows.

    A batch is held by the executor and by the worker; whole texts make the default many
    times larger than a row of numbers would. A session's own setting stays.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread only; nothing depends on its local disk.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more."""
    for table in tables:
        discard_path(table.sparkSession, table.written_to)


def discard_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that no live table needs, and the driver its garbage."""
    _release()
    spark.sparkContext._jvm.System.gc()


def row_keys(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Add a key that is distinct for every row: the doc_id where each row has its own.

    Rows that share a doc_id, or have none, are rows of their own; the table is then
    written with a number for each row, so that every later read sees the same numbers.
    """
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if seen["n"] == seen["ids"]:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def bitmap_of(values: DataFrame, column: str, size: int) -> np.ndarray:
    """Bits at value modulo size (a power of two) of a column of longs, as bytes.

    Built by tasks in slices; its size is fixed by the caller. A filter only: what passes
    still has to be joined exactly.
    """
    slices = 16

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in rows:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        z = zstandard.ZstdCompressor(level=1)
        yield pa.record_batch([pa.array(range(slices), pa.int32()), pa.array([z.compress(b.tobytes()) for b in bits.reshape(slices, -1)], pa.binary())], names=["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        unz = zstandard.ZstdDecompressor()
        out = np.zeros(size // 8 // slices, np.uint8)
        for part in table["bits"].to_pylist():
            out |= np.frombuffer(unz.decompress(part), np.uint8)
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    parts = values.select(F.col(column).cast("long")).mapInArrow(mark, "slice int, bits binary")
    rows = parts.groupBy("slice").applyInArrow(merge, "slice int, bits binary").orderBy("slice").collect()
    return np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8) if rows else np.zeros(size // 8, np.uint8)


#: Bits of a filter of keys, at most (16 MB).
FILTER_BITS = 1 << 27


def filter_bits(count: int) -> int:
    """A filter's bits: sixteen for each value, as a power of two, up to FILTER_BITS."""
    return min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))


def key_filter(keys: DataFrame, column: str) -> Broadcast:
    """A filter of fixed size that holds all values of a long column, for all tasks."""
    return keys.sparkSession.sparkContext.broadcast(bitmap_of(keys, column, filter_bits(keys.count())))


def passing(df: DataFrame, column: str, bits: Broadcast, inside: bool = True) -> DataFrame:
    """Rows whose key may be in a filter, or those whose key is surely not.

    Texts that a join does not concern are so kept out of its shuffle; what passes still
    has to be joined.
    """

    def choose(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                held = in_bitmap(bits.value, batch.column(column).cast(pa.int64()).to_numpy())
                yield batch.filter(pa.array(held if inside else ~held))

    return df.mapInArrow(lean(choose), df.schema)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit set."""
    at = values.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def make_dirs(spark: SparkSession, path: str) -> None:
    """Make a folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def write_blob(folder: str, name: str, content: bytes) -> None:
    """Write one file from an executor; a retried task replaces it as a whole."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, f"{base}/{name}")


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, counted over the whole table."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return row["n"], row["b"] or 0


def parts_for(size: int, each: int, least: int = 1) -> int:
    """How many pieces of about `each` units hold `size` units."""
    return max(least, -(-size // each))


def flat_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches_of(rows: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of a column, or one row."""
    for batch in rows:
        if not batch.num_rows:
            continue
        sizes = np.diff(flat_strings(batch.column(column))[1])
        at = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(at)) + 1
        start = 0
        for stop in [*cuts.tolist(), batch.num_rows]:
            if stop > start:
                yield batch.slice(start, stop - start)
            start = stop
