"""Stream queries run to the end of their input, with batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.plans.registry import query, table
from loomtext.sources.barrier import fresh_path
from loomtext.streaming import monitor


def _to_end(spark, frame, mode: str):
    """Run a stream over what is there and give the table it wrote."""
    folder = fresh_path(spark, "stream")

    def write(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # A file source wants a folder or a glob of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ext_tumbling", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    done = _to_end(spark, monitor.tumbling(_events(spark, sf_dir)), "complete")
    return done.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n", F.round("value", 3).alias("value"))


@query("z1_stream_ingest", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def ingest(spark, sf_dir):
    done = _to_end(spark, _events(spark, sf_dir).select("event_id", "event_type", "user_id"), "append")
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


LATEST = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id AS revision, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, event_type AS source, value FROM events),
 l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY revision DESC) AS n FROM e)"""


def _as_metadata(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.lit("entity").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("revision"),
        F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("source"), "value",
    )


@query("z2_latest_revision", LATEST + " SELECT k AS \"key\", revision, d AS \"day\", source FROM l WHERE n = 1")
def z2(spark, sf_dir):
    return monitor.latest(_as_metadata(spark, sf_dir)).select("key", "revision", "day", "source")


@query("z3_stream_snapshot", LATEST + " SELECT source, substring(d, 1, 7) AS \"month\", count(*) AS entities, round(sum(value), 3) AS value FROM l WHERE n = 1 GROUP BY 1, 2")
def z3(spark, sf_dir):
    return monitor.snapshot(monitor.latest(_as_metadata(spark, sf_dir))).withColumn("value", F.round("value", 3))


@query("z4_snapshot_delta", """WITH e AS (SELECT user_id AS k, event_id AS r, CAST(ts AS DATE) AS d, event_type AS source FROM events), x AS (SELECT FALSE AS later, * FROM e WHERE d < DATE '2024-01-15' UNION ALL SELECT TRUE, * FROM e),
 l AS (SELECT later, k, max_by(source, r) AS source, strftime(max_by(d, r), '%Y-%m') AS month FROM x GROUP BY 1, 2), s AS (SELECT later, source, month, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT source, month, max(n) FILTER (WHERE NOT later) AS was, max(n) FILTER (WHERE later) AS now FROM s GROUP BY 1, 2 HAVING was IS DISTINCT FROM now""")
def z4(spark, sf_dir):
    all_ = _as_metadata(spark, sf_dir)
    return monitor.snapshot_delta(monitor.snapshot(monitor.latest(all_.where("day < '2024-01-15'"))), monitor.snapshot(monitor.latest(all_)))
