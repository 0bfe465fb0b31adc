"""A revision-aware stream of metadata events: latest state, rejects, snapshots, windows.

Events are files of JSON lines. An event replaces a key's state only if its revision is
higher; an equal revision with the same payload is a replay, with another one an error.
State is kept by key, so a corrected date moves a record without counting it twice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources.publish import get_text, put_text

SCHEMA = "kind string, key string, revision long, day string, source string, value double"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Follow a folder of JSON-lines files; a broken line arrives with null fields."""
    return spark.readStream.schema(SCHEMA + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_per_batch).json(folder)


def valid() -> Column:
    """Events that can be applied; the others are counted and set aside."""
    return F.col("key").isNotNull() & F.col("revision").isNotNull() & (F.col("revision") >= 0) & F.col("kind").isin("source", "entity", "parent")


def latest(events: DataFrame) -> DataFrame:
    """One row a key: the payload of its highest revision, and whether that one conflicts.

    Rows may carry a `conflict` of an earlier state; it holds until a higher revision.
    """
    known = events.withColumn("conflict", F.lit(False)) if "conflict" not in events.columns else events
    sound = known.where(valid()).withColumn("payload", F.xxhash64("day", "source", "value"))
    # Of one revision the payload with the least hash stands, so replays agree.
    top = F.max(F.struct("revision", (-F.col("payload").cast("decimal(20,0)")).alias("p"), "day", "source", "value"))
    grouped = sound.groupBy("kind", "key", "revision").agg(top.alias("t"), F.min("payload").alias("a"), F.max("payload").alias("b"), F.bool_or("conflict").alias("was"))
    one = grouped.groupBy("kind", "key").agg(F.max_by(F.struct("t", ((F.col("a") != F.col("b")) | F.col("was")).alias("conflict")), F.col("revision")).alias("s"))
    return one.select("kind", "key", F.col("s.t.revision").alias("revision"), "s.t.day", "s.t.source", "s.t.value", "s.conflict")


def snapshot(state: DataFrame) -> DataFrame:
    """Distinct keys by source and month of the current state."""
    ok = state.where("kind = 'entity' and not conflict")
    return ok.groupBy("source", F.substring("day", 1, 7).alias("month")).agg(F.count_distinct("key").alias("entities"), F.round(F.sum("value"), 6).alias("value"))


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells that appear, go or change between two snapshots."""
    a, b = before.alias("a"), after.alias("b")
    on = F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.month").eqNullSafe(F.col("b.month"))
    both = a.join(b, on, "full_outer").select(F.coalesce("a.source", "b.source").alias("source"), F.coalesce("a.month", "b.month").alias("month"), F.col("a.entities").alias("was"), F.col("b.entities").alias("now"))
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def follow(events: DataFrame, state_path: str, checkpoint: str, parts: int = 64):
    """Fold each micro-batch into the state table; a batch that is replayed changes nothing.

    The state lies in `parts` slices by a hash of the key, each in a folder for every
    version; POINTERS says which version of a slice holds. A batch rewrites only the
    slices that its keys fall into, beside the old versions, and the pointers move last,
    so a failed batch leaves the last good state in place. Conflicted keys stay in the
    state with their revision: a lower revision that comes later is stale.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(valid()).select("kind", "key", "revision", "day", "source", "value", F.lit(False).alias("conflict"), _slice(parts).alias("slice"))
        touched = sorted(r["slice"] for r in fresh.select("slice").distinct().collect())
        pointers = read_pointers(spark, state_path, number)
        old = [f"{state_path}/version={pointers[s]}/slice={s}" for s in touched if s in pointers]
        if old:
            fresh = fresh.drop("slice").unionByName(spark.read.parquet(*old).select("kind", "key", "revision", "day", "source", "value", "conflict"))
        folded = latest(fresh).withColumn("slice", _slice(parts))
        folded.write.mode("overwrite").partitionBy("slice").parquet(f"{state_path}/version={number}")
        moved = pointers | dict.fromkeys(touched, number)
        put_text(spark, f"{state_path}/POINTERS-{number:012d}.json", json.dumps(moved))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _slice(parts: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(parts)).cast("int")


def read_pointers(spark: SparkSession, state_path: str, before: int | None = None) -> dict[int, int]:
    """Which version of each slice holds, as of the last batch, or the last before a number."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/POINTERS-*.json")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    names = sorted(f.getPath().toString() for f in found)
    names = [n for n in names if before is None or int(n.rsplit("-", 1)[1][:-5]) < before]
    return {int(s): v for s, v in json.loads(get_text(spark, names[-1])).items()} if names else {}


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The current state of all keys."""
    pointers = read_pointers(spark, state_path)
    return spark.read.parquet(*[f"{state_path}/version={v}/slice={s}" for s, v in sorted(pointers.items())])


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Extension: counts and sums by event-time window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Extension: sessions of a user, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
